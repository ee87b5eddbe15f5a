"""Plain versions of the operators' rules, and small tables with the awkward cases."""

import collections
import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(VOCABULARY)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, spans string, size string, label string, fp string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table(spark, texts, source=lambda n: f"s{n % 3}"):
    """Documents with ids 0, 1, ... and extra columns whose names the operators use inside."""
    rows = [(n, t, None, source(n), None, "r", "s", "x", None, "f") for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n):
    """``n`` made-up words."""
    state, out = seed * 2654435761 % 2**32 or 1, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(hashlib.md5(str(state >> 8).encode()).hexdigest()[: 2 + state % 7])
    return " ".join(out)


AWKWARD = [None, "", " \n\t ", "one", "one two", "Ünï cödé 漢字 😀", "same same same same", "same same same same", "a" * 3000, "line\n\nline\nline\n", "<|endoftext|> x"]


def removed_bytes(texts, length):
    """(n_removed, n_spans, digest of the rest) of every text, by counting all windows."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len([s for s in re.split(b"\0+", bytes(gone)) if s])
        out.append((sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def labels_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
