"""Token counts that survive edits without counting a document again.

A text is cut into leaves at single spaces between two other characters.  Whatever the
rest of the text, a pre-token ends before such a space and one starts with it, so leaves
are encoded by themselves and a cut stays valid as long as the three characters around
it do.  Each document keeps two segment trees over its leaves, of characters and of
tokens; both are arrays in heap order.  An edit descends the character tree to the
leaves it touches, takes in neighbours whose cut it disturbs, encodes only the new text of
those leaves, and updates the sums on the way up.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import append_columns
from .packing import encoder, vocabulary_path

CUT = re.compile(r"(?<=\S) (?=\S)")
LEAF_CHARS = 256


def leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """The text in leaves of about ``size`` characters, more where there is no place to cut."""
    out, at, n = [], 0, len(text)
    while n - at > size:
        m = CUT.search(text, at + size)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


@dataclass
class Tree:
    """Sums over ``width`` leaf slots (a power of two): node ``i`` has children ``2i`` and
    ``2i + 1``, leaf ``j`` is node ``width + j``."""

    chars: np.ndarray
    tokens: np.ndarray

    @property
    def width(self) -> int:
        return len(self.chars) // 2

    def locate(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place`` (the last leaf for the end), and its start."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place - start >= self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        change = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += change[0]
            self.tokens[node] += change[1]
            node //= 2


def build(text: str, count: Callable[[str], int], size: int = LEAF_CHARS) -> Tree:
    parts = leaves(text, size)
    width = 1 << (len(parts) - 1).bit_length()
    chars, tokens = np.zeros(2 * width, np.int64), np.zeros(2 * width, np.int64)
    chars[width : width + len(parts)] = [len(p) for p in parts]
    tokens[width : width + len(parts)] = [count(p) for p in parts]
    for tree in (chars, tokens):
        below = width
        while below > 1:
            tree[below // 2 : below] = tree[below : 2 * below].reshape(-1, 2).sum(1)
            below //= 2
    return Tree(chars, tokens)


def _resplit(text: str, slots: int) -> list[str]:
    """The text in at most ``slots`` leaves, cut where it is safe."""
    out, at = [], 0
    for left in range(slots, 1, -1):
        m = CUT.search(text, at + max(1, (len(text) - at) // left))
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def normal(edits: list[tuple[int, int, str]], n: int) -> list[tuple[int, int, str]]:
    """Edits by place, within the text and without overlap; of overlapping ones the first
    (by start, then end, then text) counts."""
    out: list[tuple[int, int, str]] = []
    for a, b, new in sorted((min(max(a, 0), n), min(max(a, b, 0), n), s or "") for a, b, s in edits):
        if not out or a >= out[-1][1] and (a, b) != out[-1][:2]:
            out.append((a, b, new))
    return out


def apply_edits(text: str, tree: Tree, edits: list[tuple[int, int, str]], count: Callable[[str], int]) -> tuple[str, int]:
    """Update ``tree`` in place; returns the new text and how many characters were encoded.

    ``edits`` are normal and refer to the old text.
    """
    pieces, done, encoded, i = [], 0, 0, 0
    regions = []
    while i < len(edits):
        first, start = tree.locate(max(0, edits[i][0] - 2))
        end, last = start, first - 1
        j = i
        while True:  # leaves up to the first cut that no edit of the region disturbs
            reach = max((e[1] for e in edits[i:j]), default=edits[i][1])
            while end < len(text) and end < reach + 1 or last < first:
                last += 1
                end += int(tree.chars[tree.width + last])
            if j < len(edits) and (j == i or edits[j][0] <= end + 1):
                j += 1
            else:
                break
        regions.append((first, last, start, end, edits[i:j]))
        i = j
    for first, last, start, end, own in regions:
        new, at = [], start
        for a, b, s in own:
            new += [text[at:a], s]
            at = b
        new = "".join([*new, text[at:end]])
        parts = _resplit(new, last - first + 1)
        for k in range(first, last + 1):
            part = parts[k - first] if k - first < len(parts) else ""
            tree.put(k, len(part), count(part) if part else 0)
        encoded += len(new)
        pieces += [text[done:start], new]
        done = end
    return "".join([*pieces, text[done:]]), encoded


TREE = T.StructType([T.StructField("chars", T.ArrayType(T.LongType())), T.StructField("tokens", T.ArrayType(T.LongType()))])


def _counter(path: str) -> Callable[[str], int]:
    encode = encoder(path)
    return lambda s: len(encode(s))


def count_tokens(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_tokens`` and ``tree``, the state that later edits need.

    Counts whole texts with the byte-level vocabulary at ``path``; null and empty texts have no
    token.  Repeated rows are counted alike, an empty table gives an empty result, columns
    named like the new ones are replaced.
    """
    path = path or vocabulary_path()

    def make():
        count = _counter(path)

        def run(texts):
            trees = [build(t or "", count) for t in texts]
            return {
                "n_tokens": [int(t.tokens[1]) for t in trees],
                "tree": [{"chars": t.chars.tolist(), "tokens": t.tokens.tolist()} for t in trees],
            }

        return run

    return append_columns(docs, ["text"], [("n_tokens", T.LongType()), ("tree", TREE)], make, keep)


EDITS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("replacement", T.StringType())])
)


def with_edits(counted: DataFrame, edits: DataFrame) -> DataFrame:
    """Attach ``edits(doc_id, start, end, replacement)`` to their documents; a null key matches
    none.  A document's edits are no more than its characters once overlaps are gone."""
    lists = edits.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set(F.struct("start", "end", "replacement")).alias("edits")
    )
    return counted.drop("edits").join(lists, F.col("doc_id") == F.col("_id"), "left").drop("_id")


def recount(counted: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Apply the column ``edits`` to rows of :func:`count_tokens`: replaces ``text``, ``n_tokens``
    and ``tree``, and adds ``n_edits`` and ``n_encoded``, the characters that were encoded again.

    Places are code points of the old text with the end exclusive.  Null edits change nothing,
    parts outside the text are cut off, a null replacement deletes, and of overlapping edits
    the first counts.
    """
    path = path or vocabulary_path()

    def make():
        count = _counter(path)

        def run(texts, trees, edits):
            out = {n: [] for n in ("text", "n_tokens", "tree", "n_edits", "n_encoded")}
            for text, state, wanted in zip(texts, trees, edits, strict=True):
                tree = Tree(np.array(state["chars"], np.int64), np.array(state["tokens"], np.int64))
                own = normal([(e["start"], e["end"], e["replacement"]) for e in wanted or []], len(text or ""))
                new, encoded = apply_edits(text or "", tree, own, count) if own else (text, 0)
                out["text"].append(new)
                out["n_tokens"].append(int(tree.tokens[1]))
                out["tree"].append({"chars": tree.chars.tolist(), "tokens": tree.tokens.tolist()})
                out["n_edits"].append(len(own))
                out["n_encoded"].append(encoded)
            return out

        return run

    fields = [("text", T.StringType()), ("n_tokens", T.LongType()), ("tree", TREE), ("n_edits", T.LongType()), ("n_encoded", T.LongType())]
    return append_columns(counted, ["text", "tree", "edits"], fields, make, keep)


LONG_NUMBER = re.compile(r"\d{6,}")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+")


def cleaning_edits(text: str | None) -> list[tuple[int, int, str]]:
    """The edits of a cleaning run: lines equal to an earlier one go, addresses and long
    numbers are masked."""
    text = text or ""
    out, seen, at = [], set(), 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        if line.strip() and line in seen:
            out.append((at, end, ""))
        seen.add(line)
        at += len(line) + 1
    out += [(*m.span(), "<mail>") for m in ADDRESS.finditer(text)] if "@" in text else []
    return normal(out + [(*m.span(), "<number>") for m in LONG_NUMBER.finditer(text)], len(text))


def with_cleaning(counted: DataFrame) -> DataFrame:
    """Adds ``edits`` found by :func:`cleaning_edits`."""
    row = lambda t: [dict(zip(("start", "end", "replacement"), e, strict=True)) for e in cleaning_edits(t)]
    return append_columns(counted, ["text"], [("edits", EDITS)], lambda: lambda texts: {"edits": [row(t) for t in texts]})
