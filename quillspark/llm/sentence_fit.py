"""Problem 5 over whole tables: the model of sentences.py fitted on every cell, and applied to the same cells.

The places of cells stay in tables of the shared folder, a row a batch of cells; counts are Spark aggregations. Of a place the model sees its kind only: the class of the
word before, the class of the word after, and whether the mark is open evidence. So a round of expectation-maximisation broadcasts
two weights a kind and brings back one sum a kind: what the driver holds grows with the vocabulary at candidate places and not
with the cells. Posteriors are summed as integers (steps of 2^-30), so neither partitions nor their order change the result.

Trigrams serve only stretches that have lost their marks: they are counted over all other sentences, and each stretch is joined to
the counts it needs. Only where there is such a stretch are texts read a second time.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.sentences import LEAST_COUNT, LENGTHS, MOST_RATIO, ROUNDS, Model, Place, first_word, places, stops
from quillspark.llm.unmarked import TOKEN as WORD
from quillspark.llm.unmarked import LEAST_TRIGRAM, SPACELESS, Lengths, NGrams, count_tokens, grams, needed, words_of
from quillspark.session import cut_lineage, spread

ONE = 1 << 30
SHAPES = ("<none>", "<number>", "<initial>", "<capital>", "<small>", "<caseless>", "<other>")
#: Bits of a kind: 32 for the class before, 30 for the class after, 1 for open evidence.
AFTER_BITS, SHAPE_BEFORE, SHAPE_AFTER = 30, 1 << 31, 1 << 29
#: Length of the open sentence after n more words, by n and the length before.
STEP = np.minimum(np.arange(LENGTHS + 1)[:, None] + np.arange(LENGTHS + 1)[None, :], LENGTHS)

COUNTS = "kind array<int>, word array<string>, n array<long>, stopped array<long>"
BEFORE, AFTER, TOKEN = range(3)
PLACE, FIRST, LAST = range(3)
SPANS = "rec_table string, rec_id long, char_start int, char_end int"


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}
    kind = lambda t: pa.list_(types[t[6:-1]]) if t.startswith("array") else types[t]
    return pa.schema([(name, kind(t)) for name, t in (c.split(" ") for c in ddl.split(", "))])


def _packed(columns: dict[str, pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[bytes, ...]]:
    """Values of binary columns, one row at a time in memory."""
    for b in batches:
        for row in zip(*(b.column(c) for c in columns), strict=True):
            yield tuple(x.as_py() for x in row)


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    return pa.array(rows, pa.list_(kind))


def _segments(text: str, start: int, cell: list[Place]) -> tuple[list[int], list[bool], list[bool]]:
    """Tokens between places, whether the script has no spaces there, and whether a token goes on across the place."""
    n, spaceless, across = [], [], []
    for p in cell:
        part = text[start : p.end]
        n.append(count_tokens(part))
        spaceless.append(not part.isascii() and bool(SPACELESS.search(part)))
        across.append(p.next == p.end >= 2 and bool(WORD.fullmatch(text, p.end - 2, p.end + 1)))
        start = p.next
    return n, spaceless, across


def _cells(b: pa.RecordBatch) -> Iterator[tuple[str, int, str, list[Place]]]:
    """Cells that aren't blank."""
    for table, id_, text in zip(*(b.column(c).to_pylist() for c in ("rec_table", "rec_id", "text")), strict=True):
        if text.strip():
            yield table, id_, text, places(text)


def _start(text: str) -> int:
    return len(text) - len(text.lstrip())


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidate places of cells, and counts of their words and tokens, a row a batch."""
    schema = _schema("places binary, " + COUNTS)
    for b in batches:
        rows, written, tokens, stopped = [], Counter(), Counter(), Counter()
        for table, id_, text, cell in _cells(b):
            written.update(text.split())
            start = _start(text)
            rows.append((table, id_, start, [p.end for p in cell], [p.next for p in cell], [min(max(p.words, 1), LENGTHS) for p in cell[:-1]], *_segments(text, start, cell), [p.before for p in cell], [p.after for p in cell], first_word(text)))
        if not rows:
            continue
        stops(written, tokens, stopped)
        tables, ids, starts, ends, nexts, words, n, spaceless, across, befores, afters, firsts = zip(*rows, strict=True)
        packed = {
            "rec_table": pa.array(tables, pa.string()).dictionary_encode(), "rec_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int32()),
            "ends": _lists(ends, pa.int32()), "nexts": _lists(nexts, pa.int32()), "words": _lists(words, pa.int8()), "tokens": _lists(n, pa.int32()), "spaceless": _lists(spaceless, pa.bool_()), "across": _lists(across, pa.bool_()),
            "before": _coded(befores), "after": _coded(afters), "first": pa.array(firsts, pa.string()).dictionary_encode(),
        }
        seen = (Counter(w for x in befores for w in x), Counter(w for x in afters for w in x) + Counter(firsts), tokens)
        counts = [(kind, w, c, stopped[w] if kind == TOKEN else 0) for kind, by in enumerate(seen) for w, c in by.items()]
        yield _batch(schema, [(_packed(packed), *map(list, zip(*counts, strict=True)))])


def _coded(rows: list[list[str]]) -> pa.ListArray:
    flat = pa.array([w for x in rows for w in x], pa.string()).dictionary_encode()
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in rows])), pa.int32()), flat)


class Classes:
    """Numbers of the classes of words before and after, and of open evidence."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.befores, self.afters = ({w: k for k, w in enumerate(sorted(kept))} for kept in (model.kept_before, model.kept_after))

    def before(self, w: str) -> int:
        c = self.model.before(w)
        k = self.befores.get(c)
        return SHAPE_BEFORE | SHAPES.index(c[:-2]) << 21 | ord(c[-1]) if k is None else k

    def after(self, w: str) -> int:
        c = self.model.after(w)
        k = self.afters.get(c)
        return SHAPE_AFTER | SHAPES.index(c.removesuffix(" joined")) << 1 | c.endswith(" joined") if k is None else k

    def kinds(self, before: pa.ListArray, after: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kinds of all places of a batch but the last ones of cells, their number by cell, and the classes of the last."""
        flat_before, flat_after = before.flatten(), after.flatten()
        words = flat_before.dictionary.to_pylist()
        classes = _numbers(map(self.before, words), len(words))[flat_before.indices.to_numpy()]
        open_ = _numbers((self.model.belief(w)[0] < 1 for w in words), len(words))[flat_before.indices.to_numpy()]
        words = flat_after.dictionary.to_pylist()
        codes = classes << (AFTER_BITS + 1) | _numbers(map(self.after, words), len(words))[flat_after.indices.to_numpy()] << 1 | open_
        sizes = before.value_lengths().to_numpy()
        inner = np.ones(len(codes), bool)
        inner[np.cumsum(sizes) - 1] = False
        return codes[inner], sizes - 1, classes[~inner]


def _numbers(x: Iterator[int], n: int) -> np.ndarray:
    return np.fromiter(x, np.int64, n)


def _encode(classes: Classes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places by their kinds, with counts of kinds, and of first words and last places by classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema("kinds binary, places binary, kind array<int>, code array<long>, n array<long>")
        for (data,) in _rows(batches, "places"):
            x = _unpacked(data)
            codes, sizes, last = classes.kinds(x.column("before"), x.column("after"))
            first = x.column("first")
            words = first.dictionary.to_pylist()
            first = _numbers(map(classes.after, words), len(words))[first.indices.to_numpy()]
            used, at = np.unique(codes, return_inverse=True)
            coded = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.DictionaryArray.from_arrays(pa.array(at, pa.int32()), pa.array(used)))
            kept = {c: x.column(c) for c in ("rec_table", "rec_id", "start", "ends", "nexts", "tokens", "spaceless", "across")}
            counts = [(kind, int(c), int(n)) for kind, by in ((PLACE, codes), (FIRST, first), (LAST, last)) for c, n in zip(*np.unique(by, return_counts=True), strict=True)]
            yield _batch(schema, [(_packed({"codes": coded, "words": x.column("words")}), _packed(kept), *map(list, zip(*counts, strict=True)))])

    return run


class Weights:
    """Weights of boundary and none of every kind of place, and of every length of the open sentence."""

    def __init__(self, codes: np.ndarray, yes: np.ndarray, no: np.ndarray, ratio: np.ndarray, prior: bool) -> None:
        self.codes, self.yes, self.no, self.ratio, self.prior = codes, yes, no, ratio, prior

    def posteriors(self, kind: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of a boundary at each place before the last ones of cells with so many: as Model.posteriors, for all cells of a batch at once."""
        if self.prior:
            return self.yes[kind]
        out = np.empty(len(kind))
        steps = list(_steps(sizes))
        forward, f = [], np.zeros((LENGTHS + 1, len(steps[0]) if steps else 0))
        f[0] = 1.0
        for at in steps:
            f = f[:, : len(at)]
            forward.append(f)
            y, z, n, cells = self.yes[kind[at]], self.no[kind[at]], words[at], np.arange(len(at))
            new = np.zeros((LENGTHS + 1, len(at)))
            for s in range(LENGTHS + 1):
                t = STEP[s][n]
                new[0] += f[s] * y * self.ratio[t]
                new[t, cells] += f[s] * z
            f = new / _or_one(new.sum(axis=0))
        back = np.ones((LENGTHS + 1, len(steps[0]) if steps else 0))  # a last place leaves no choice
        for at, f in zip(reversed(steps), reversed(forward), strict=True):
            y, z, n, cells = self.yes[kind[at]], self.no[kind[at]], words[at], np.arange(len(at))
            new, hit, all_ = np.empty((LENGTHS + 1, len(at))), np.zeros(len(at)), np.zeros(len(at))
            for s in range(LENGTHS + 1):
                t = STEP[s][n]
                ends = y * self.ratio[t] * back[0, : len(at)]
                new[s] = ends + z * back[t, cells]
                hit += f[s] * ends
                all_ += f[s] * new[s]
            out[at] = np.where(all_ > 0, hit / _or_one(all_), 1.0)
            back[:, : len(at)] = new / _or_one(new.max(axis=0))
        return out

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Kinds, words and posteriors of all places of a batch but the last ones of cells, and their number by cell."""
        b = _unpacked(data)
        codes = b.column("codes").flatten()
        kind = np.searchsorted(self.codes, codes.dictionary.to_numpy())[codes.indices.to_numpy()]
        words, sizes = b.column("words").flatten().to_numpy(), b.column("codes").value_lengths().to_numpy()
        return kind, words, self.posteriors(kind, words, sizes), sizes


def _or_one(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, 1.0, x)


def _steps(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of the first, second, ... places of all cells that have one, the cells with most places first."""
    order = np.argsort(-sizes, kind="stable")
    first, left = (np.cumsum(sizes) - sizes)[order], sizes[order]
    for i in range(int(left[0]) if len(left) else 0):
        yield first[: np.searchsorted(-left, -i, side="left")] + i


def _expect(weights: Weights) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of posteriors by kind, and of boundary and none by length (negative codes), once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, length = np.zeros(len(weights.codes), np.int64), np.zeros((LENGTHS + 1, 2), np.int64)
        for (data,) in _rows(batches, "kinds"):
            kind, words, y, sizes = weights.of(data)
            whole = np.rint(y * ONE).astype(np.int64)
            np.add.at(sums, kind, whole)
            open_ = np.zeros(len(sizes), np.int64)
            for at in _steps(sizes):
                o = np.minimum(open_[: len(at)] + words[at], LENGTHS)
                np.add.at(length, (o, 0), whole[at])
                np.add.at(length, (o, 1), ONE - whole[at])
                open_[: len(at)] = np.where(y[at] > 0.5, 0, o)
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(weights.codes[hit], -1 - np.arange(length.size))), pa.array(np.append(sums[hit], length.ravel()))], names=["code", "y"])

    return run


class Counts:
    """What doesn't change from round to round: places of every kind, last places and first words by class, cells."""

    def __init__(self, encoded: DataFrame, model: Model) -> None:
        t = encoded.select(F.inline(F.arrays_zip("kind", "code", "n"))).groupBy("kind", "code").agg(F.sum("n").alias("n")).toArrow().sort_by("code")
        kind, code, n = (t[c].to_numpy() for c in ("kind", "code", "n"))
        (self.codes, self.n), (first, begins), (last, ends) = ((code[kind == k], n[kind == k]) for k in (PLACE, FIRST, LAST))
        self.cells, self.size = int(ends.sum()), len(model.kept_after) + 12
        before, self.after = self.codes >> (AFTER_BITS + 1), (self.codes >> 1) & ((1 << AFTER_BITS) - 1)
        self.b, self.b_of = np.unique(before, return_inverse=True)
        self.a, self.a_of = np.unique(self.after, return_inverse=True)
        self.pair, self.pair_of = np.unique(self.codes >> 1, return_inverse=True)
        self.ends, self.begins = (np.array([by.get(k, 0) for k in keys.tolist()], np.int64) for keys, by in ((self.b, dict(zip(last.tolist(), ends.tolist(), strict=True))), (self.a, dict(zip(first.tolist(), begins.tolist(), strict=True)))))
        open_ = (self.codes & 1).astype(bool)
        self.more, self.less = np.where(open_, 0.5, 2000.0), np.where(open_, 2.0, 1.0)

    def start(self) -> Weights:
        return Weights(self.codes, self.more / (self.more + self.less), self.less, np.ones(LENGTHS + 1), True)

    def weights(self, sums: np.ndarray, length: np.ndarray) -> Weights:
        """As Model.fit counts and Model.factors weighs, from sums of posteriors (in steps) by kind and by length."""

        def by(groups: np.ndarray, size: int, x: np.ndarray) -> np.ndarray:
            out = np.zeros(size, np.int64)
            np.add.at(out, groups, x)
            return out / ONE

        none = self.n * ONE - sums
        yes, no = by(self.b_of, len(self.b), sums) + self.ends, by(self.b_of, len(self.b), none)
        starts, follow = by(self.a_of, len(self.a), sums) + self.begins, by(self.a_of, len(self.a), none)
        pairs = by(self.pair_of, len(self.pair), none)[self.pair_of]
        starts_total, follow_total = int(sums.sum()) / ONE + self.cells, int(none.sum()) / ONE
        prior = (yes[self.b_of] + self.more) / (yes[self.b_of] + no[self.b_of] + self.more + self.less)
        start = (starts[self.a_of] + 0.5) / (starts_total + 0.5 * self.size)
        loose = (follow[self.a_of] + 0.5) / (follow_total + 0.5 * self.size)
        near = np.minimum(np.maximum((pairs + 2.0 * loose) / (no[self.b_of] + 2.0), start / MOST_RATIO), start * MOST_RATIO)
        length = 1.0 + length / ONE
        length[LENGTHS, 0] += self.cells  # the ends of cells
        ended, went_on = length.sum(axis=0)
        ratio = np.minimum(np.maximum(length[:, 0] / ended / (length[:, 1] / went_on), 1 / MOST_RATIO), MOST_RATIO)
        return Weights(self.codes, prior * start, (1 - prior) * near, ratio, False)


def _fit(encoded: DataFrame, model: Model) -> Weights:
    counts = Counts(encoded, model)
    weights, before = counts.start(), None
    places_ = encoded.select("kinds").coalesce(encoded.sparkSession.sparkContext.defaultParallelism)  # a task's sums are as many rows as kinds
    for _ in range(ROUNDS):
        t = places_.mapInArrow(_expect(weights), "code long, y long").groupBy("code").agg(F.sum("y").alias("y")).toArrow()
        code, y = t["code"].to_numpy(), t["y"].to_numpy()
        sums, length = np.zeros(len(counts.codes), np.int64), np.zeros((LENGTHS + 1) * 2, np.int64)
        sums[np.searchsorted(counts.codes, code[code >= 0])] = y[code >= 0]
        length[-1 - code[code < 0]] = y[code < 0]
        now = np.append(sums, length)
        if before is not None and np.array_equal(before, now):
            break  # all further rounds would be the same
        before = now
        weights = counts.weights(sums, length.reshape(-1, 2))
    return weights


def _told(y: np.ndarray, sizes: np.ndarray, starts: list[int], ends: list[list[int]], nexts: list[list[int]]) -> Iterator[list[tuple[int, int, int, int]]]:
    """Of each cell the offsets of its sentences by marks, and the numbers of their first and last places."""
    at, hit = 0, (y > 0.5).tolist()
    for start, ends_, nexts_, n in zip(starts, ends, nexts, sizes.tolist(), strict=True):
        out, first = [], 0
        for k, (end, next_, yes) in enumerate(zip(ends_, nexts_, [*hit[at : at + n], True], strict=True)):
            if yes and end > start:
                out.append((start, end, first, k))
                start, first = next_, k + 1
        at += n
        yield out


def _by_marks(weights: Weights) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(SPANS + ", tokens int, spaceless boolean")
        for kinds, data in _rows(batches, "kinds", "places"):
            _, _, y, sizes = weights.of(kinds)
            x = _unpacked(data)
            tables, ids, starts, ends, nexts, tokens, spaceless, across = (x.column(c).to_pylist() for c in ("rec_table", "rec_id", "start", "ends", "nexts", "tokens", "spaceless", "across"))
            rows = [
                (table, id_, s, e, sum(n[i : k + 1]) - sum(joined[i:k]), any(dense[i : k + 1]))
                for table, id_, n, dense, joined, spans in zip(tables, ids, tokens, spaceless, across, _told(y, sizes, starts, ends, nexts), strict=True)
                for s, e, i, k in spans
            ]
            if rows:
                yield _batch(schema, rows)

    return run


def _again(b: pa.RecordBatch, classes: Classes, weights: Weights) -> Iterator[tuple[str, int, int, str]]:
    """Table, id, offset and text of every sentence by marks of a batch of cells."""
    rows = list(_cells(b))
    if not rows:
        return
    tables, ids, texts, cells = zip(*rows, strict=True)
    codes, sizes, _ = classes.kinds(*(_coded([[getattr(p, side) for p in c] for c in cells]) for side in ("before", "after")))
    words = np.array([min(max(p.words, 1), LENGTHS) for c in cells for p in c[:-1]], np.int64)
    y = weights.posteriors(np.searchsorted(weights.codes, codes), words, sizes)
    told = _told(y, sizes, list(map(_start, texts)), [[p.end for p in c] for c in cells], [[p.next for p in c] for c in cells])
    for table, id_, text, spans in zip(tables, ids, texts, told, strict=True):
        for s, e, _, _ in spans:
            yield table, id_, s, text[s:e]


def _count_grams(classes: Classes, weights: Weights, limits: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of words after their histories in the sentences that have their marks, summed by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = Counter()
            for _, _, _, part in _again(b, classes, weights):
                words = words_of(part)
                if words and len(words) < limits[bool(SPACELESS.search(part))]:
                    for g in grams(words):
                        counts.update(g)
            if counts:
                rows = [(" ".join(g[:-1]), g[-1], n) for g, n in counts.items()]
                yield _batch(_schema("head string, word string, n long"), rows)

    return run


def _lost(classes: Classes, weights: Weights, limits: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The stretches that have lost their marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for x in _again(b, classes, weights) if count_tokens(x[3]) >= limits[bool(SPACELESS.search(x[3]))]]
            if rows:
                yield _batch(_schema("rec_table string, rec_id long, char_start int, part string"), rows)

    return run


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema("stretch long, head string, word string")
    for b in batches:
        for stretch, text in zip(*(b.column(c).to_pylist() for c in ("stretch", "part")), strict=True):
            yield _batch(schema, [(stretch, " ".join(g[:-1]), g[-1]) for g in needed(words_of(text))])


def _by_words(lengths: tuple[Lengths, Lengths], total: int, kinds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sentences of the stretches that have lost their marks, each by the counts it was joined to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for table, id_, start, text, known in zip(*(b.column(c).to_pylist() for c in ("rec_table", "rec_id", "char_start", "part", "known")), strict=True):
                counts: dict[int, dict] = defaultdict(dict)
                after: dict = {}
                for g in known:
                    head = tuple(g["head"].split())
                    if g["n"] is not None:
                        counts[len(head)][(*head, g["word"]) if head else g["word"]] = g["n"]
                    if head and g["total"] is not None:
                        after[head if len(head) > 1 else head[0]] = (g["total"], g["kinds"])
                model = NGrams.of(counts[0], counts[1], counts[2], after, total, kinds, lengths)
                yield _batch(_schema(SPANS), [(table, id_, start + s, start + e) for s, e in model.split(text, 0, len(text))])

    return run


def _unmarked(cells: DataFrame, classes: Classes, weights: Weights, lengths: tuple[Lengths, Lengths]) -> DataFrame:
    limits = (lengths[0].limit, lengths[1].limit)
    stretches = cells.mapInArrow(_lost(classes, weights, limits), "rec_table string, rec_id long, char_start int, part string")
    stretches = cut_lineage(stretches.withColumn("stretch", F.monotonically_increasing_id()), "unmarked")
    counted = cells.mapInArrow(_count_grams(classes, weights, limits), "head string, word string, n long")
    counted = counted.groupBy("head", "word").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted.where((F.instr("head", " ") == 0) | (F.col("n") >= LEAST_TRIGRAM)), "grams")
    after = counted.groupBy("head").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    words = after.where("head = ''").head()
    total, kinds = (words["total"], words["kinds"] + 1) if words else (0, 1)
    known = stretches.select("stretch", "part").mapInArrow(_needs, "stretch long, head string, word string")
    known = known.join(counted, ["head", "word"], "left").join(after.where("head <> ''"), "head", "left")
    known = known.groupBy("stretch").agg(F.collect_list(F.struct("head", "word", "n", "total", "kinds")).alias("known"))
    return stretches.join(known, "stretch").select("rec_table", "rec_id", "char_start", "part", "known").mapInArrow(_by_words(lengths, total, kinds), SPANS)


def _lengths(spans: DataFrame) -> tuple[Lengths, Lengths]:
    """Lengths of the sentences of scripts with spaces and without."""
    rows = spans.where("tokens > 0").groupBy("spaceless", "tokens").count().collect()
    out = []
    for spaceless in (False, True):
        n = {r["tokens"]: r["count"] for r in rows if r["spaceless"] == spaceless}
        counts = np.zeros(max(n, default=1) + 1, np.int64)
        counts[list(n)] = list(n.values())
        out.append(Lengths(counts))
    return out[0], out[1]


def fitted_spans(cells: DataFrame) -> DataFrame:
    """(rec_table, rec_id, char_start, char_end) of every sentence of cells (rec_table, rec_id, text), by a model fitted on all of them; null and blank texts have none."""
    cells = spread(cells.select("rec_table", "rec_id", "text").where("text is not null"))
    parsed = cut_lineage(cells.mapInArrow(_parse, "places binary, " + COUNTS), "places")
    counts = parsed.select(F.inline(F.arrays_zip("kind", "word", "n", "stopped"))).groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("stopped").alias("stopped"))
    abbreviation = F.expr("stopped >= 0.8D * n and (n >= 10 or (n > 1 and length(word) <= 3))")
    kept: tuple[set[str], set[str], set[str]] = (set(), set(), set())
    for r in counts.where(F.when(F.col("kind") == TOKEN, abbreviation).otherwise(F.col("n") >= LEAST_COUNT)).select("kind", "word").collect():
        kept[r["kind"]].add(r["word"])
    model = Model()
    model.kept_before, model.kept_after, model.stopped = kept
    classes = Classes(model)
    encoded = cut_lineage(parsed.select("places").mapInArrow(_encode(classes), "kinds binary, places binary, kind array<int>, code array<long>, n array<long>"), "kinds")
    weights = _fit(encoded, model)
    spans = cut_lineage(encoded.select("kinds", "places").mapInArrow(_by_marks(weights), SPANS + ", tokens int, spaceless boolean"), "sentences")
    lengths = _lengths(spans)
    lost = F.col("tokens") >= F.when(F.col("spaceless"), lengths[1].limit).otherwise(lengths[0].limit)
    columns = ("rec_table", "rec_id", "char_start", "char_end")
    if not spans.where(lost).limit(1).count():
        return spans.select(*columns)
    return spans.where(~lost).select(*columns).unionAll(_unmarked(cells, classes, weights, lengths).select(*columns))
