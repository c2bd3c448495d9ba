"""Removal of passages that repeat, by level-wise doubling of windows of words (operator 9)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from tidemark.llm.common import bucketed
from tidemark.llm.words import WORD_MULT_2, window_hashes, word_hashes

#: Bytes of text after which a map group is closed (a longer text is one by itself), and what each row counts besides its text.
BLOCK_BYTES, ROW_BYTES = 4 << 20, 16

SHORT = "block long, key long, many int"
FULL = "block long, one long, two long, doc_id long, place long"
KEPT = "row long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in ddl.split(", ")])


def leftmost_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each place the one of the least hash among it and the next width - 1 (the first of equal ones); one place fewer for each of these."""
    at, have = np.arange(len(hashes)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(hashes[left] <= hashes[right], left, right)
        have += step
    return at


class Block:
    """The words of some documents, in the order of doc_id (null first), equal ones in the order of their rows."""

    def __init__(self, table: pa.Table, levels: list[int]):
        row, key = np.asarray(table.column("row")), table.column("doc_id").to_pylist()
        self.order = sorted(range(len(key)), key=lambda i: (key[i] is not None, key[i] or 0, row[i]))
        self.rows = row[self.order]
        self.keys = [key[i] for i in self.order]
        texts = table.column("text").cast(pa.binary()).to_pylist()
        self.texts = [texts[i] for i in self.order]
        self.words, self.bounds = word_hashes(self.texts)
        self.levels = levels
        ok, self.one = window_hashes(self.words, self.bounds, levels[-1])
        #: Where the windows of full length begin.
        self.at = np.flatnonzero(ok)

    def hashes(self, level: int) -> np.ndarray:
        """A hash of the window of `level` words that begins at each word (0 where none does)."""
        ok, own = window_hashes(self.words, self.bounds, level)
        out = np.zeros(len(self.words), dtype=np.uint64)
        out[ok] = own
        return out

    def places(self, level: int) -> np.ndarray:
        """Where the window of `level` words begins that stands for each full one.

        It is the place of the least hash of the first level among those where half of the full length still fits in:
        equal windows choose alike, neighbours mostly share their choice, and each level doubles the same window.
        """
        if level == self.levels[-1] or not len(self.at):
            return self.at
        return leftmost_least(self.hashes(self.levels[0]), self.levels[-1] // 2 + 1)[self.at]

    def candidates(self, level: int, again: np.ndarray | None) -> np.ndarray:
        """Which full windows are looked at on `level`: those whose window of half that length is among `again` (all on the first level)."""
        if again is None:
            return np.ones(len(self.at), dtype=bool)
        half = self.levels[self.levels.index(level) - 1]
        return np.isin(self.hashes(half)[self.places(half)], again)

    def distinct(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the chosen full windows, in the order of one hash: their numbers, and which begin a run of equal ones (its first place)."""
        one, two = self.one[chosen], self.two()[chosen]
        order = np.argsort(one, kind="stable")
        same, other = one[order][1:] == one[order][:-1], two[order][1:] != two[order][:-1]
        if (same & other).any():  # windows that only the second hash tells apart
            order = np.lexsort((two, one))
            same, other = one[order][1:] == one[order][:-1], two[order][1:] != two[order][:-1]
        return order, np.append(True, ~same | other)[: len(order)]

    def two(self) -> np.ndarray:
        """The second hash of each full window."""
        return window_hashes(self.words, self.bounds, self.levels[-1], WORD_MULT_2)[1]


def short_rows(name: int, block: Block, level: int, again: np.ndarray | None) -> pa.Table:
    """The distinct short windows of a map group, and whether it holds each more than once (many is 2 then)."""
    place = np.unique(block.places(level)[block.candidates(level, again)])
    key, many = np.unique(block.hashes(level)[place], return_counts=True)
    return pa.table([np.full(len(key), name), key.view(np.int64), np.minimum(many, 2).astype(np.int32)], schema=_arrow(SHORT))


def full_rows(name: int, block: Block, again: np.ndarray | None) -> pa.Table:
    """The distinct full windows of a map group by two hashes, with the doc_id of the first document of each and its place in the group."""
    chosen = np.flatnonzero(block.candidates(block.levels[-1], again))
    order, new = block.distinct(chosen)
    firsts = np.sort(chosen[order[new]])
    places = block.at[firsts]
    ids = pa.array(block.keys, pa.int64()).take(pa.array(np.searchsorted(block.bounds, places, side="right") - 1))
    return pa.table([np.full(len(firsts), name), block.one[firsts].view(np.int64), block.two()[firsts].view(np.int64), ids, places], schema=_arrow(FULL))


def kept_rows(block: Block, later: np.ndarray, whole: bool) -> pa.Table:
    """What is left of each text; later: first places in this group of the full windows that an earlier one has too."""
    order, new = block.distinct(np.arange(len(block.at)))
    known = np.zeros(len(block.words) + 1, dtype=bool)
    known[later] = True
    first = np.zeros(len(block.at), dtype=bool)
    first[order] = new
    first &= ~known[block.at]
    gone_at, size, full = block.at[~first], len(block.words) + 1, block.levels[-1]
    gone = np.cumsum(np.bincount(gone_at, minlength=size) - np.bincount(gone_at + full, minlength=size))[:-1] > 0
    rows = []
    for i, text in enumerate(block.texts):
        own = gone[block.bounds[i] : block.bounds[i + 1]]
        words, lost = (text or b"").split(), int(own.sum())
        kept = b" ".join([w for w, g in zip(words, own.tolist(), strict=True) if not g] if lost else words)
        rows.append({
            "row": int(block.rows[i]), "doc_id": block.keys[i], "n_words": len(own), "n_removed": lost,
            "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode() if lost else text.decode() if whole and text is not None else None,
        })
    return pa.Table.from_pylist(rows, schema=_arrow(KEPT))


def kept_words(docs: DataFrame, window: int = 20, start: int = 5, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """For each row of `docs` (doc_id, text) the text without repeated passages; a row number says which row is meant.

    Returns row (in the order of reading), doc_id, n_words, n_removed, kept (the words that stay, joined by a space; null
    where nothing is removed) and kept_sha256 (of those words, always). With `carry`, columns of docs, these come along as a
    struct doc, and kept is the whole text, as it was where nothing is removed. A word goes if it lies in a window of
    `window` words whose sequence also starts earlier: in a smaller doc_id (null before all), or earlier in the same document.

    Each full window is looked for by a window of `start` words within it, the one of least hash. Where that repeats in
    the corpus, it is extended to twice its length, and so on until it is half of the full window, the full window, or none
    is left; window / start must be a power of two. Map groups are consecutive texts of about `block_bytes`, written once as a table bucketed by
    group, so that no level shuffles texts. A group sends each of its distinct short windows as a row of a key and a count,
    and gets back the keys that repeat: rows and bytes a window don't depend on the size of the corpus. Full windows are
    told by two 64-bit hashes; the places of those come back that an earlier group has too. A passage that thousands of documents share is one row
    in each map group that has it, so a key has at most one row a group.

    Null text: no words. Rows with the same doc_id count as one document after another, in the order of their rows. No
    rows: no rows. Fewer words than the window: nothing is removed. Other columns are ignored.
    """
    levels = [start << k for k in range(64) if start << k <= window]
    if levels[-1:] != [window]:
        raise ValueError("window must be start, doubled some times")
    table = bucketed(in_blocks(docs, block_bytes, carry), "block", docs)
    slim = table.select("block", "row", "doc_id", "text")

    def over_groups(reply: Callable, ddl: str, again: DataFrame | None, source: DataFrame = slim) -> DataFrame:
        """Runs reply(name, table of texts, table of keys that came back or None) over the map groups."""
        schema = _parse_datatype_string(ddl)
        if "doc" in source.columns:
            schema = schema.add("doc", source.schema["doc"].dataType)
        if again is None:
            return source.groupBy("block").applyInArrow(lambda key, text: reply(key[0].as_py(), text, None), schema)
        return source.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(lambda key, text, back: reply(key[0].as_py(), text, back), schema)

    again: DataFrame | None = None
    for level in levels[:-1]:

        def short(name: int, text: pa.Table, back: pa.Table | None, level: int = level) -> pa.Table:
            if back is not None and not back.num_rows:
                return _arrow(SHORT).empty_table()
            return short_rows(name, Block(text, levels), level, None if back is None else np.asarray(back.column("key")).view(np.uint64))

        seen = over_groups(short, SHORT, again).withColumn("n", F.sum("many").over(Window.partitionBy("key")))
        again = seen.where("n > 1").select("block", "key")

    def full(name: int, text: pa.Table, back: pa.Table | None) -> pa.Table:
        if back is not None and not back.num_rows:
            return _arrow(FULL).empty_table()
        return full_rows(name, Block(text, levels), None if back is None else np.asarray(back.column("key")).view(np.uint64))

    order = Window.partitionBy("one", "two").orderBy(F.col("doc_id").asc_nulls_first(), "block")
    later = over_groups(full, FULL, again).withColumn("n", F.row_number().over(order)).where("n > 1").select("block", "place")

    def finish(name: int, text: pa.Table, back: pa.Table) -> pa.Table:
        block = Block(text, levels)
        out = kept_rows(block, np.asarray(back.column("place")), bool(carry))
        return out.append_column("doc", text.column("doc").take(pa.array(block.order, pa.int64()))) if carry else out

    return over_groups(finish, KEPT, later, table if carry else slim)


def in_blocks(docs: DataFrame, block_bytes: int, carry: list[str] | None = None) -> DataFrame:
    """block, row, doc_id, text, and a struct doc of the columns `carry`. row numbers the rows as they are read; block is its group's first row."""
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc")] if carry else []
    rows = docs.select(F.monotonically_increasing_id().alias("block"), F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, 0
        for batch in batches:
            row = np.asarray(batch.column("row"))
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64) + ROW_BYTES
            block, lo = np.empty(len(row), dtype=np.int64), 0
            while lo < len(row):
                if now is None or held >= block_bytes:
                    now, held = row[lo], 0
                total = np.cumsum(sizes[lo:])
                hi = min(len(row), lo + int(np.searchsorted(total, block_bytes - held)) + 1)
                block[lo:hi] = now
                held += int(total[hi - lo - 1])
                lo = hi
            yield batch.set_column(0, "block", pa.array(block))

    return rows.mapInArrow(cut, rows.schema)
