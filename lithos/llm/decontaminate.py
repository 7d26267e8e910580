"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import fresh, materialize

WINDOW = 10
BLOCK = 200_000

#: What is no word character becomes a blank, A-Z become a-z; bytes from 0x80 on are word characters.
_fold = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def tokens(text: str | bytes | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all characters beyond ASCII."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_fold).split()


class SuffixAutomaton:
    """All runs of words of a block of items, with the items that each window occurs in.

    A window is a run of ``window`` words of one item, or a whole item of
    fewer. States and moves are at most two and three per word.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.moves: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        held: list[set[int]] = [set()]
        for i, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, w, held)
                held[last].add(i)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for s in order:  # an item that has a run has its suffixes
            held[self.link[s]] |= held[s]
        #: at: the state of the last ``window`` words, for states of as many; short: (words, item) of whole items that end a state.
        self.at = [0] * len(self.link)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for i, (_, words) in enumerate(items):
            if 0 < len(words) < window:
                s = 0
                for w in words:
                    s = self.moves[s][w]
                self.short[s] = (*self.short[s], (len(words), i))
        for s in reversed(order):
            up = self.link[s]
            self.short[s] = self.short[s] + self.short[up]
            if self.length[s] >= window:
                self.at[s] = s if self.length[up] < window else self.at[up]
        self.items = {s: frozenset(held[s]) for s in set(self.at) if s}

    def _extend(self, last: int, w: bytes, held: list[set[int]]) -> int:
        moves, link, length = self.moves, self.link, self.length
        if w in moves[last]:
            q = moves[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q, held)
        new = len(link)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        held.append(set())
        p = last
        while p >= 0 and w not in moves[p]:
            moves[p][w] = new
            p = link[p]
        if p >= 0:
            q = moves[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q, held)
        return new

    def _clone(self, p: int, w: bytes, q: int, held: list[set[int]]) -> int:
        moves, link, length = self.moves, self.link, self.length
        new = len(link)
        moves.append(dict(moves[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        held.append(set())
        link[q] = new
        while p >= 0 and moves[p].get(w) == q:
            moves[p][w] = new
            p = link[p]
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit runs ``(first, end)`` of words, merged, in order; numbers of the items hit.

        The words are streamed once; what is tracked is the state and the
        length of the longest run of an item that ends at each word.
        """
        moves, link, length, at, short, window = self.moves, self.link, self.length, self.at, self.short, self.window
        runs: list[list[int]] = []
        hit: set[int] = set()
        state = size = 0
        for i, w in enumerate(words):
            to = moves[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = moves[state].get(w)
                if to is None:
                    size = 0
                    continue
                size = length[state]
            state = to
            size += 1
            reach = 0
            if size >= window:
                reach = window
                hit |= self.items[at[state]]
            if short[state]:
                for n, item in short[state]:
                    if n <= size:
                        reach = max(reach, n)
                        hit.add(item)
            if reach:
                first = i + 1 - reach
                while runs and runs[-1][0] >= first:
                    runs.pop()
                if runs and runs[-1][1] >= first:
                    runs[-1][1] = i + 1
                else:
                    runs.append([first, i + 1])
        return [(a, b) for a, b in runs], hit


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = BLOCK, window: int = WINDOW) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of ``size`` words at most, read one partition at a time.

    An item of more words comes in pieces that overlap by a window less one
    word, so that each window is in one piece, and none is a short item.
    """
    size = max(size, window)
    held: list[tuple[str, list[bytes]]] = []
    n = 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).orderBy(id_col, text_col)
    for name, text in rows.toLocalIterator():
        words = tokens(text)
        for at in range(0, max(len(words) - window + 1, min(len(words), 1)), size - window + 1):
            piece = words[at : at + size]
            if held and n + len(piece) > size:
                yield held
                held, n = [], 0
            held.append((name or "", piece))
            n += len(piece)
    if held:
        yield held


RUNS = "array<struct<first:bigint,end:bigint>>"


def _pairs(runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"first": a, "end": b} for a, b in runs]


def _tuples(runs: list[dict[str, int]]) -> list[tuple[int, int]]:
    return [(r["first"], r["end"]) for r in runs]


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def _by_block(benchmark: DataFrame, args: tuple, work: Callable[[SuffixAutomaton], DataFrame]) -> DataFrame | None:
    """Union of ``work`` for the automaton of each block, written block by block, so that one automaton at a time is held; None without items."""
    found = None
    for block in blocks(benchmark, *args):
        automaton = benchmark.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, args[-1]))
        part = materialize(work(automaton), "hits")
        automaton.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def _first_blocks(benchmark: DataFrame, args: tuple) -> list[list[tuple[str, list[bytes]]]]:
    """Two blocks at most: whether one automaton holds the whole benchmark."""
    return list(itertools.islice(blocks(benchmark, *args), 2))


def _text_hits(texts: DataFrame, benchmark: DataFrame, args: tuple) -> DataFrame:
    """``(key, n_words, runs, items)`` of the distinct texts ``(key, text)`` that windows occur in, over all blocks."""
    schema = f"key string, n_words long, runs {RUNS}, items array<string>"
    arrow = _arrow(schema)

    def work(automaton: object) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = automaton.value
            for batch in batches:
                rows = []
                for key, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                    words = tokens(text.as_py())
                    runs, hit = known.match(words)
                    if runs:
                        rows.append((key.as_py(), len(words), _pairs(runs), sorted({known.names[i] for i in hit})))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(4)], schema=arrow)

        return texts.mapInArrow(run, schema).dropDuplicates(["key"])

    found = _by_block(benchmark, args, work)
    return found.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def find_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, size: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_words, runs, items, *carry)``, a row for each row of ``docs``, repeated rows included.

    runs: merged ``(first, end)`` word numbers inside occurrences of windows
    of any item; items: the ids, as strings, of the items with such windows,
    sorted, each once. A null text has no words, an item without words no
    window; a null item id is the empty string. An empty table of documents
    gives no row, an empty benchmark rows without runs. A text costs time in
    proportion to its length, however long.

    Items are broadcast as one automaton of ``size`` words at most. A larger
    benchmark takes a pass over the texts for each block, which writes the
    hits of distinct texts only; they are then joined by the texts' MD5.
    """
    args = (item_col, item_text, size, window)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    few = _first_blocks(benchmark, args)
    automaton = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(few[0], window)) if len(few) == 1 else None
    out = base.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.array().cast(RUNS).alias("runs"), F.array().cast("array<string>").alias("items"), F.md5("text").alias("key"), *carry)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton.value if automaton else None
        for batch in batches:
            n, runs, items = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                words = tokens(text.as_py())
                spans, hit = known.match(words) if known else ([], set())
                n.append(len(words))
                runs.append(_pairs(spans))
                items.append(sorted({known.names[i] for i in hit}) if hit else [])
            cols = [pa.array(x, arrow.field(i + 1).type) for i, x in enumerate((n, runs, items))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *batch.columns[1:2], *batch.columns[3:]], schema=arrow)

    found = base.select("doc_id", F.md5("text").alias("key"), "text", *carry).mapInArrow(run, out.schema)
    if len(few) < 2:
        return found.drop("key")
    hits = _text_hits(docs.select(F.md5(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text")).filter("key is not null"), benchmark, args)
    joined = found.drop("runs", "items").join(hits.select("key", _merged(F.col("runs")).alias("runs"), "items"), "key", "left")
    return joined.select("doc_id", "n_words", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), *carry)


def _merged(runs: Column) -> Column:
    """Runs in order, those that touch made one."""
    empty = F.array().cast(RUNS)

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        touching = (F.size(done) > 0) & (r["first"] <= F.try_element_at(done, F.lit(-1))["end"])
        wider = F.struct(last["first"].alias("first"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when(touching, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(runs), empty, add)


class Gaps:
    """The words cut from a text, as maximal runs over which it is walked."""

    def __init__(self, runs: list[tuple[int, int]] = ()) -> None:
        self.end_of = dict(runs)
        self.start_of = {b: a for a, b in runs}

    def cut(self, a: int, b: int) -> tuple[int, int]:
        """Take out the words from a to b; the maximal run they are in now."""
        at = a
        while at < b:
            if at in self.end_of:
                at = self._drop(at)
            else:
                at += 1
        b = max(at, b)
        if b in self.end_of:
            b = self._drop(b)
        if a in self.start_of:
            a = self.start_of[a]
            self._drop(a)
        self.end_of[a], self.start_of[b] = b, a
        return a, b

    def _drop(self, a: int) -> int:
        b = self.end_of.pop(a)
        del self.start_of[b]
        return b

    def around(self, a: int, b: int, reach: int, n: int) -> list[int]:
        """Numbers of the ``reach`` words left on each side of the run from a to b."""
        out = []
        while len(out) < reach:
            a = self.start_of.get(a, a)
            if not a:
                break
            a -= 1
            out.append(a)
        out.reverse()
        stop = len(out) + reach
        while len(out) < stop:
            b = self.end_of.get(b, b)
            if b >= n:
                break
            out.append(b)
            b += 1
        return out

    def runs(self) -> list[tuple[int, int]]:
        return sorted(self.end_of.items())


def seam_hits(words: list[bytes], gaps: Gaps, fresh: list[tuple[int, int]], known: SuffixAutomaton) -> list[tuple[int, int]]:
    """Runs that windows hit across the cuts of ``fresh``: only there can new windows be."""
    found = []
    for a, b in fresh:
        at = gaps.around(a, b, known.window - 1, len(words))
        found += [(at[x], at[y - 1] + 1) for x, y in known.match([words[i] for i in at])[0]]
    return merged(found)


def cut_all(gaps: Gaps, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Take out ``found``; the maximal runs that changed."""
    changed = [gaps.cut(a, b) for a, b in found]
    return sorted({(a, b) for a, b in changed if gaps.end_of.get(a) == b})


def cut(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the words in ``runs``; a line break stands for each run."""
    spans = [m.span() for m in _word.finditer(text)]
    out, at = [], 0
    for a, b in runs:
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "\n".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", window: int = WINDOW, coverage: float = 0.5, size: int = BLOCK) -> DataFrame:
    """``docs`` without benchmark passages: rows of which windows cover over ``coverage`` of the words go, from the others the spans.

    Words that meet only after a cut can make a new window; cutting goes on
    until there is none. chars_col, if the table has it, holds the new number
    of characters of changed texts. All columns stay, and null texts;
    repeated rows are treated alike; empty tables of documents or of items
    give the documents as they are. Time is in proportion to a text's length.

    The result does not depend on ``size``: windows of all blocks decide
    together on coverage and on each round of cuts. With one block a task
    does all rounds of a text; with more, each round is a pass for each
    block, the first over ``docs`` (hand in a written table), later ones over
    the texts that were cut in the round before.
    """
    args = ("item_id", "text", size, window)
    few = _first_blocks(benchmark, args)
    if not few:
        return docs
    return _clean_at_once(docs, few[0], text_col, chars_col, window, coverage) if len(few) == 1 else _clean_by_rounds(docs, benchmark, args, text_col, chars_col, coverage)


def _clean_at_once(docs: DataFrame, block: list[tuple[str, list[bytes]]], text_col: str, chars_col: str | None, window: int, coverage: float) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    automaton = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, window))
    arrow, at = to_arrow_schema(docs.schema), docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton.value
        for batch in batches:
            stay, texts = [], []
            changed = False
            for i, raw in enumerate(batch.column(at).cast(pa.binary())):
                words = tokens(raw.as_py())
                runs, _ = known.match(words)
                if not runs:
                    stay.append(i)
                    texts.append(None)
                    continue
                changed = True
                if sum(b - a for a, b in runs) > coverage * len(words):
                    continue
                gaps = Gaps()
                while runs:
                    runs = seam_hits(words, gaps, cut_all(gaps, runs), known)
                stay.append(i)
                texts.append(cut(raw.as_py().decode(), gaps.runs()))
            if not changed:
                yield batch
                continue
            kept = batch.take(pa.array(stay, pa.int64()))
            cols = list(kept.columns)
            cols[at] = pa.array([old.as_py() if new is None else new for old, new in zip(cols[at], texts, strict=True)], arrow.field(at).type)
            if chars is not None:
                sizes = [old.as_py() if new is None else len(new) for old, new in zip(cols[chars], texts, strict=True)]
                cols[chars] = pa.array(sizes, arrow.field(chars).type)
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return docs.mapInArrow(run, docs.schema)


def _clean_by_rounds(docs: DataFrame, benchmark: DataFrame, args: tuple, text_col: str, chars_col: str | None, coverage: float) -> DataFrame:
    state = f"key string, text string, gone {RUNS}, fresh {RUNS}"
    found_schema = f"key string, runs {RUNS}"
    arrow, found_arrow = _arrow(state), _arrow(found_schema)
    keyed = docs.select(F.md5(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text")).filter("key is not null")
    hits = materialize(_text_hits(keyed, benchmark, args).withColumn("runs", _merged(F.col("runs"))), "hits")
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    gone = hits.filter(n_hit > F.lit(coverage) * F.col("n_words")).select("key")
    cuts = hits.filter(n_hit <= F.lit(coverage) * F.col("n_words")).select("key", "runs")
    none = F.array().cast(RUNS)
    open_ = keyed.join(cuts.select("key"), "key", "left_semi").dropDuplicates(["key"]).withColumn("gone", none).withColumn("fresh", none)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = [Gaps(_tuples(g.as_py())) for g in batch.column(2)]
            fresh = [_pairs(cut_all(g, _tuples(r.as_py()))) for g, r in zip(gaps, batch.column(4), strict=True)]
            cols = [pa.array(x, arrow.field(i + 2).type) for i, x in enumerate(([_pairs(g.runs()) for g in gaps], fresh))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], schema=arrow)

    done = None
    while True:
        now = materialize(open_.join(cuts, "key").select("key", "text", "gone", "fresh", "runs").mapInArrow(apply, state), "open")

        def work(automaton: object, now: DataFrame = now) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                known = automaton.value
                for batch in batches:
                    rows = []
                    for key, text, before, fresh in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3), strict=True):
                        runs = seam_hits(tokens(text.as_py()), Gaps(_tuples(before.as_py())), _tuples(fresh.as_py()), known)
                        if runs:
                            rows.append((key.as_py(), _pairs(runs)))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], found_arrow.field(i).type) for i in range(2)], schema=found_arrow)

            return now.mapInArrow(run, found_schema)

        more = _by_block(benchmark, args, work)
        cuts = materialize(more.groupBy("key").agg(_merged(F.flatten(F.collect_list("runs"))).alias("runs")), "cuts")
        settled = now.join(cuts.select("key"), "key", "left_anti").select("key", "text", "gone")
        done = settled if done is None else done.unionByName(settled)
        if cuts.isEmpty():
            break
        open_ = now

    key, new, drop = fresh(docs, "_key"), fresh(docs, "_new"), fresh(docs, "_drop")
    cleaned = F.udf(lambda text, runs: cut(text, _tuples(runs)), "string", useArrow=True)
    verdicts = materialize(done.select(F.col("key").alias(key), cleaned("text", "gone").alias(new), F.lit(False).alias(drop)).unionByName(gone.select(F.col("key").alias(key), F.lit(None).cast("string").alias(new), F.lit(True).alias(drop))), "verdicts")
    joined = docs.withColumn(key, F.md5(F.col(text_col).cast("string"))).join(verdicts, key, "left").filter(~F.coalesce(F.col(drop), F.lit(False)))
    cols = []
    for c in docs.columns:
        value = F.coalesce(F.col(new), F.col(f"`{c}`")) if c == text_col else F.when(F.col(new).isNotNull(), F.length(new)).otherwise(F.col(f"`{c}`")).cast(docs.schema[c].dataType) if c == chars_col else F.col(f"`{c}`")
        cols.append(value.alias(c))
    return joined.select(*cols)


def digests(found: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` from ``find_windows``."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
