"""Documents with every odd case, and plain-Python forms of what the operators do."""

from __future__ import annotations

import random
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Extra columns whose names the operators use inside.
CLASHING = ("score", "predicted", "rep", "key", "component", "family", "anchor", "doc", "shard", "slot", "_h", "_n", "label", "size", "ids", "node", "kept", "weight", "links", "valid")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = "[^\x20\x09-\x0D]+"


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(n)]


def odd_texts() -> list[str | None]:
    base = words(120, 1)
    near = base[:60] + ["changed"] + base[61:]
    return [
        " ".join(base), " ".join(near), None, "", "   \n\t ", "one", "Two words", " ".join(base), " ".join(words(40, 2) + base[30:70] + words(30, 3)), " ".join(["la"] * 90), "\n".join(words(30000, 4)),
        "Licensed under CC BY-NC 4.0. All rights reserved.", "日本語 のテキスト 😀 ▁x \x00y", " ".join(base).upper(), " ".join(words(50, 5)), " ".join(words(50, 5)), " ".join(base[:19]), " ".join(base[:20]),
    ]


def frame(spark, texts: list[str | None] | None = None, extra: bool = True, partitions: int = 3) -> DataFrame:
    texts = odd_texts() if texts is None else texts
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 3 % 2}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if extra else df


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split(text: str | None) -> list[str]:
    return re.findall(BLANK, text or "")


def shingles(text: str | None, k: int) -> set:
    w = split(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def component_ids(ids: list, linked) -> dict:
    """The smallest id reachable of each, by pairs that ``linked`` holds for."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_duplicates(texts: dict, k: int, percent: int) -> dict:
    sets = {i: shingles(t, k) for i, t in texts.items()}
    return component_ids(sorted(texts), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))


def kept_words(texts: dict, window: int = 20) -> dict:
    """Words of each text and which of them go."""
    seen, out = set(), {}
    for i in sorted(texts):
        w = split(texts[i])
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if key in seen:
                gone[j : j + window] = [True] * window
            seen.add(key)
        out[i] = (w, gone)
    return out


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())
