"""Repeated passages by a sparse suffix array over the words of all texts.

Suffixes are retained at content-selected positions only: of every `passage` consecutive words, the leftmost least hash
of a `seed`-word window (a minimiser). Equal passages select the same relative positions, so a passage that occurs twice
leaves two retained suffixes that begin with the same `seed` words.

1. Filter: a retained suffix is a row of its seed's hash, text and position. Suffixes whose hash no other one has are
   dropped; the hash decides about nothing else.
2. Suffix array: the others carry their words: those from the position on (up to `passage`), and those before it as far
   as a passage that selects this position can begin. Suffixes with one seed are brought together and sorted by
   their words.
3. Neighbours: the common prefix of neighbours in that order, in words, bounds how far a suffix can match any other.
   Matches are extended to the left and the right: in a run of two by their common words on either side; in
   longer runs the passages that the bounds allow are grouped and compared word by word, since a suffix with the longest
   common prefix need not be the one that agrees to the left.

So a word is in a repeated span if and only if it lies in a passage of `passage` words that occurs again, in another
text or elsewhere in the same one; words are compared, and colliding hashes cost time only. (In runs of over `PART`
suffixes, which are dealt to parts by text and position, passages are compared by words within a part, and the parts'
first ones by 128-bit digests.) Texts are told apart by 128 bits.

Copies of a text are one text, represented by the row with the least id; a copy is a repeat from its first word to its
last. Of equal passages the one with the least (id of its text's representative, text, position) is the first and stays;
so ties between rows are broken by the id, then the text, then the position.

Edge cases: null, empty and short texts (fewer words than a passage) have no spans; rows with the same id and text are
one document; null ids are ids like any other (the least); empty tables give empty tables; very long texts are handled
in one piece of memory each (some 60 bytes a word), and their repeated passages are rows like those of other texts;
other columns, whatever their names, are passed through by `cut_repeats` and not read by `repeated_spans`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, text_bytes, text_digests
from .kernel import Words, distinct, mix, windows

PASSAGE, SEED = 50, 11
#: Suffixes of a run that are compared in one task; a longer run is dealt to parts of about this size.
PART = 4_096
#: Tasks that a long run's positions are joined in.
SALTS = 64
#: Digests that a task remembers.
MET = 1_000_000
#: Bits of hashes that are used; fewer in tests, so that hashes collide.
BITS = 64
PLACE = ("d1", "d2", "pos")


def minimisers(words: Words, hashes: np.ndarray, passage: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows of `passage` words, the retained position of each, hashes of `seed` words at every position)."""
    heads = windows(hashes, seed)
    if len(hashes) < passage:
        return np.empty(0, np.int64), np.empty(0, np.int64), heads
    width = passage - seed + 1
    best, at = heads.copy(), np.arange(len(heads))
    reach = 1
    while reach < width:  # the least of `reach` positions becomes that of up to twice as many
        step = min(reach, width - reach)
        left, right = best[:-step], best[step:]
        take = right < left
        best = np.concatenate((np.where(take, right, left), best[-step:]))
        at = np.concatenate((np.where(take, at[step:], at[:-step]), at[-step:]))
        reach += step
    starts = np.flatnonzero(words.room(passage))
    return starts, at[starts], heads


def word_count(text: Column) -> Column:
    """Words as the kernel counts them."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))


def _masked(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes if bits == 64 else hashes & np.uint64((1 << bits) - 1)


def _suffixes(passage: int, seed: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()  # texts that this task has read: of their copies it makes no rows again
        for part in blocks(batches, "text"):
            new = []
            for dig in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                new.append(dig not in met)
                met.add(dig)
            if len(met) > MET:
                met.clear()
            part = part.filter(pa.array(new))
            words = Words(*text_bytes(part.column(2)))
            _, anchors, heads = minimisers(words, words.hashes(), passage, seed)
            anchors = distinct(anchors)
            row = words.row[anchors]
            keys = _masked(heads[anchors], bits).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(part.column(k).take(pa.array(row)) for k in (0, 1)), pa.array((anchors - words.of_row[row]).astype(np.int32))], ["key", *PLACE])

    return run


def recurring(found: DataFrame, salts: int) -> DataFrame:
    """(key, d1, d2, pos): the suffixes whose key another one has.

    A key's rows are dealt by salts; the first of each salt meet in a second round.
    """
    dealt = found.withColumn("salt", F.pmod(F.xxhash64(*PLACE), F.lit(salts)).cast("int")).repartition("key", "salt").dropDuplicates(["key", "salt", *PLACE])
    order = Window.partitionBy("key", "salt").orderBy(*PLACE)
    near = dealt.select("key", *PLACE, F.lag("pos").over(order).alias("before"), F.lead("pos").over(order).alias("after"))
    later = near.where("before is not null").select("key", *PLACE)
    order = Window.partitionBy("key").orderBy(*PLACE)
    heads = near.where("before is null").select("key", *PLACE, "after", F.lag("pos").over(order).alias("other"), F.lead("pos").over(order).alias("next"))
    return later.unionByName(heads.where("after is not null or other is not null or next is not null").select("key", *PLACE))


def _carrying_words(passage: int, seed: int, bits: int):
    """The retained suffixes at the listed positions, with their words: `left` before the position, `right` from it on.

    Every word is followed by a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            words = Words(*text_bytes(part.column(3)))
            starts, anchors, heads = minimisers(words, words.hashes(), passage, seed)
            lists = part.column(4)
            per = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(part.num_rows), per)
            listed = lists.flatten()
            pos, parts = (listed.field(c).to_numpy().astype(np.int64) for c in ("pos", "parts"))
            at = words.of_row[row] + pos
            # passages that select a position begin one after the other
            first, last = starts[np.searchsorted(anchors, at, "left")], starts[np.searchsorted(anchors, at, "right") - 1]
            sizes = words.ends - words.starts + 1
            to = np.concatenate(([0], np.cumsum(sizes)))
            plain = np.full(int(to[-1]), 32, np.uint8)
            inside = np.arange(len(plain)) - np.repeat(to[:-1], sizes)
            from_ = np.repeat(words.starts, sizes) + inside
            is_word = inside < np.repeat(sizes - 1, sizes)
            plain[is_word] = words.data[from_[is_word]]
            plain = plain.tobytes()
            cut = lambda a, b: pa.array([plain[x:y] for x, y in zip(to[a].tolist(), to[b].tolist(), strict=True)], pa.binary())  # noqa: E731, B023
            d1, d2, ids = (part.column(k).take(pa.array(row)) for k in range(3))
            salt = (mix(d1.to_numpy().view(np.uint64) ^ mix(pos.view(np.uint64))) % parts.astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_masked(heads[at], bits).view(np.int64)), pa.array(salt), pa.array(parts > 1), ids, d1, d2, pa.array(pos.astype(np.int32)), cut(first, at), cut(at, last + passage)],
                ["key", "part", "dealt", "id", *PLACE, "left", "right"],
            )

    return run


def _word_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words of each row, offsets of the rows' first words, all words): of texts whose words all end with a space."""
    data, offsets = text_bytes(column)
    ends = np.flatnonzero(data == 32) + 1
    of_row = np.searchsorted(ends, offsets, "right")
    bounds = np.concatenate(([0], ends)).astype(np.int32)
    every = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    return np.diff(of_row), of_row[:-1], every


def _table(numbers: np.ndarray, counts: np.ndarray, starts: np.ndarray, width: int, back: bool) -> np.ndarray:
    """A row's words in columns, from the first on or from the last back; -1 where there are none."""
    out = np.full((len(counts), width), -1, np.int32)
    row = np.repeat(np.arange(len(counts)), counts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    out[row, (counts[row] - 1 - k) if back else k] = numbers[starts[row] + k]
    return out


def _common(table: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Common words of each row with the row before, where `joined` says that they are to be compared."""
    out = np.zeros(len(table), np.int64)
    same = (table[1:] == table[:-1]) & (table[1:] >= 0)
    out[1:] = np.where(same.all(1), table.shape[1], same.argmin(1)) * joined[1:]
    return out


def _grouped(words: np.ndarray, at: np.ndarray, passage: int, bits: int) -> np.ndarray:
    """A number for each passage words[at : at + passage], equal if and only if all words are."""
    if not len(at):
        return at
    spread = mix(words.astype(np.uint64) + np.uint64(1))
    keys = _masked(windows(spread, passage)[at], bits)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    pairs, equal = np.flatnonzero(same), np.empty(0, bool)
    reach = np.arange(passage)
    step = max(1, (1 << 22) // passage)
    for k in range(0, len(pairs), step):
        p = pairs[k : k + step]
        equal = np.concatenate((equal, (words[at[order[p]][:, None] + reach] == words[at[order[p + 1]][:, None] + reach]).all(1)))
    new = np.ones(len(at), bool)
    new[1:] = ~same
    group = np.cumsum(new) - 1
    if not equal.all():  # colliding hashes: those groups are told apart by their words
        apart = np.unique(group[pairs[~equal]])
        numbers: dict[bytes, int] = {}
        for k in np.flatnonzero(np.isin(group, apart)):
            a = at[order[k]]
            group[k] = len(at) + numbers.setdefault(words[a : a + passage].tobytes(), len(numbers))
    out = np.empty(len(at), np.int64)
    out[order] = np.unique(group, return_inverse=True)[1]
    return out


def matches(table: pa.Table, passage: int, bits: int) -> pa.Table:
    """Whole runs of suffixes, sorted by their words: (id, d1, d2, first, begin, end, window, twice).

    The repeated passages in intervals of their begins; of a run that is dealt to parts, every passage that is the first
    in its part is a row with its digest instead, and `twice` says whether the part has another one.
    """
    table = table.combine_chunks()
    n = table.num_rows
    column = lambda c: table[c].combine_chunks() if isinstance(table[c].combine_chunks(), pa.Array) else table[c].chunk(0)
    left, right = column("left"), column("right")
    nl, sl, words_l = _word_numbers(left)
    nr, sr, words_r = _word_numbers(right)
    numbers = pa.concat_arrays([words_l, words_r]).dictionary_encode().indices.to_numpy()
    own_l, own_r = numbers[: len(words_l)], numbers[len(words_l) :]
    key, part, pos = table["key"].to_numpy(), table["part"].to_numpy(), table["pos"].to_numpy().astype(np.int64)
    joined = np.zeros(n + 1, bool)
    joined[1:n] = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
    reach = _common(_table(own_r, nr, sr, passage, False), joined[:n])
    most_r = np.maximum(reach, np.append(reach[1:], 0))
    behind = _common(_table(own_l, nl, sl, passage, True), joined[:n])
    # neighbours that have no other member of the run beside them bound each other on the left as well
    lone = joined[:n] & ~np.append(False, joined[: n - 1]) & ~joined[1:]
    most_l = nl.copy()
    for k in (0, 1):
        at = np.flatnonzero(lone) - k
        most_l[at] = np.minimum(nl[at], behind[at + k])
    elsewhere = table["dealt"].to_numpy(zero_copy_only=False)  # the run goes on in other parts, so neighbours bound nothing
    # a passage with l words on the left has passage - l on the right
    least = np.maximum(passage - nr, np.where(elsewhere, 0, passage - most_r))
    most_l = np.where(elsewhere, nl, most_l)
    many = np.maximum(most_l - least + 1, 0)
    row = np.repeat(np.arange(n), many)
    l = np.repeat(least, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)  # noqa: E741
    # all contexts' words in one array
    width = nl + nr
    to = np.concatenate(([0], np.cumsum(width)))
    whole = np.empty(int(to[-1]), np.int64)
    index = np.arange(len(whole)) - np.repeat(to[:-1], width)
    owner = np.repeat(np.arange(n), width)
    on_left = index < nl[owner]
    whole[on_left] = own_l[(sl[owner] + index)[on_left]]
    whole[~on_left] = own_r[(sr[owner] + index - nl[owner])[~on_left]]
    at = to[row] + nl[row] - l
    group = _grouped(whole, at, passage, bits)
    begin = pos[row] - l
    ids = column("id")
    rank = np.empty(n, np.int64)
    rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(n)
    if n:
        by = np.argsort(rank, kind="stable")
        equal = pc.equal(ids.take(pa.array(by[1:])), ids.take(pa.array(by[:-1])))
        nulls = ids.is_null().to_numpy(zero_copy_only=False)
        equal = pc.fill_null(equal, False).to_numpy(zero_copy_only=False) | (nulls[by[1:]] & nulls[by[:-1]])
        rank[by] = np.concatenate(([0], np.cumsum(~equal)))
    d1, d2 = table["d1"].to_numpy(), table["d2"].to_numpy()
    order = np.lexsort((begin, d2[row], d1[row], rank[row], group))
    first = np.zeros(len(row), bool)
    first[order] = np.concatenate(([True], group[order][1:] != group[order][:-1])) if len(row) else first
    twice = np.bincount(group)[group] > 1 if len(row) else first
    dealt = elsewhere[row] & first
    wanted = np.flatnonzero((twice & ~dealt))
    # intervals of begins: one row each
    by = wanted[np.lexsort((begin[wanted], first[wanted], row[wanted]))]
    new = np.ones(len(by), bool)
    new[1:] = (row[by][1:] != row[by][:-1]) | (first[by][1:] != first[by][:-1]) | (begin[by][1:] != begin[by][:-1] + 1)
    heads = np.flatnonzero(new)
    ends = begin[by[np.append(heads[1:], len(by)) - 1]] + passage if len(by) else begin[:0]
    alone = np.flatnonzero(dealt)
    text = [left[int(i)].as_py() + right[int(i)].as_py() for i in np.unique(row[alone])]
    of = dict(zip(np.unique(row[alone]).tolist(), text, strict=True))
    marks = []
    for k in alone.tolist():
        i = int(row[k])
        words = of[i].split(b" ")
        a = int(nl[i] - l[k])
        marks.append(hashlib.blake2b(b" ".join(words[a : a + passage]), digest_size=16).digest())
    take = pa.array(np.concatenate((row[by[heads]], row[alone])))
    return pa.table({
        "id": ids.take(take), "d1": column("d1").take(take), "d2": column("d2").take(take),
        "first": pa.array(np.concatenate((first[by[heads]], first[alone]))),
        "begin": pa.array(np.concatenate((begin[by[heads]], begin[alone])).astype(np.int32)),
        "end": pa.array(np.concatenate((ends, begin[alone] + passage)).astype(np.int32)),
        "window": pa.array([None] * len(heads) + marks, pa.binary()),
        "twice": pa.array(np.concatenate((np.ones(len(heads), bool), twice[alone]))),
    })


def _matched(passage: int, bits: int, block: int = 4 << 20):
    """Runs arrive sorted by key and part; as many whole ones as fill a block are compared at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def unlike(batch: pa.RecordBatch) -> pa.RecordBatch:
            """Without rows of the same place as the row before (a document that is there twice)."""
            nonlocal last
            place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "part", *PLACE)], axis=1)
            keep = np.ones(len(place), bool)
            keep[1:] = (place[1:] != place[:-1]).any(1)
            keep[0] = last is None or bool((place[0] != last).any())
            last = place[-1]
            return batch if keep.all() else batch.filter(pa.array(keep))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(unlike(batch))
            size += held[-1].nbytes
            if size >= block:
                table = pa.Table.from_batches(held).combine_chunks()
                key, part = table["key"].to_numpy(), table["part"].to_numpy()
                change = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]))
                if len(change):
                    stop = int(change[-1]) + 1
                    yield from matches(table.slice(0, stop), passage, bits).to_batches()
                    table = table.slice(stop)
                held, size = table.to_batches(), table.nbytes
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield from matches(table, passage, bits).to_batches()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's intervals, joined where they overlap or touch: a row for each."""
    for batch in blocks(batches, "at"):
        lists = batch.column(4)
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        begin, end = (lists.flatten().field(c).to_numpy().astype(np.int64) for c in ("begin", "end"))
        order = np.lexsort((begin, row))
        row, begin, end = row[order], begin[order], end[order]
        apart = int(end.max()) + 1 if len(end) else 1
        until = np.maximum.accumulate(end + row * apart)  # rows one after the other
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (begin[1:] + row[1:] * apart > until[:-1])
        at = np.flatnonzero(new)
        ends = until[np.append(at[1:], len(row)) - 1] - row[at] * apart if len(at) else end
        pick = pa.array(row[at])
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pick) for k in range(4)), pa.array(begin[at].astype(np.int32)), pa.array(ends.astype(np.int32))], ["id", "d1", "d2", "first", "begin", "end"])


def text_spans(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, seed: int = SEED, bits: int = BITS, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """((id, d1, d2, first, begin, end) for every text with repeated passages, (d1, d2, least id, rows) for every text)."""
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(*text_digests(F.col(text_col)), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = scratch.write(plain.groupBy("d1", "d2").agg(F.min("id").alias("least"), F.count("*").alias("rows")), "texts")
    found = plain.select("d1", "d2", "text").mapInArrow(_suffixes(passage, seed, bits), "key long, d1 long, d2 long, pos int")
    hits = scratch.write(recurring(found, max(16, math.isqrt(texts.count()))), "hits")
    long_runs = hits.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > part).select("key", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    # a long run's suffixes are dealt by the same salts to which its row is copied
    salted = hits.withColumn("salt", F.pmod(F.xxhash64(*PLACE), F.lit(SALTS)).cast("int"))
    long_runs = long_runs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    listed = salted.join(long_runs, ["key", "salt"], "left").groupBy("d1", "d2").agg(F.collect_list(F.struct("pos", F.coalesce("parts", F.lit(1)).alias("parts"))).alias("at"))
    # one row of each text: of copies, the row with the least id
    wanted = scratch.write(listed.join(texts, ["d1", "d2"]).select("d1", "d2", F.col("least").alias("id"), "at"), "wanted")
    scratch.drop("hits")
    p, w = plain.alias("p"), wanted.alias("w")
    same = (F.col("p.d1") == F.col("w.d1")) & (F.col("p.d2") == F.col("w.d2")) & F.col("p.id").eqNullSafe(F.col("w.id"))
    whole = p.join(w.hint("merge"), same).select("p.d1", "p.d2", "p.id", "p.text", "w.at")
    array = whole.mapInArrow(_carrying_words(passage, seed, bits), f"key long, part int, dealt boolean, id {kind}, d1 long, d2 long, pos int, left binary, right binary")
    array = array.repartition("key", "part").sortWithinPartitions("key", "part", "right", *PLACE)
    found = scratch.write(array.mapInArrow(_matched(passage, bits), f"id {kind}, d1 long, d2 long, first boolean, begin int, end int, window binary, twice boolean"), "found")
    scratch.drop("wanted")
    own = F.struct("id", "d1", "d2", "begin")
    heads = found.where("window is not null")
    groups = heads.groupBy("window").agg(F.count("*").alias("n"), F.min(own).alias("least"), F.max("twice").alias("again")).where("n > 1 or again")
    met = heads.join(groups, "window").withColumn("first", own.eqNullSafe(F.col("least")))
    columns = ["id", "d1", "d2", "first", "begin", "end"]
    every = found.where("window is null").select(*columns).unionByName(met.select(*columns))
    spans = every.groupBy("id", "d1", "d2", "first").agg(F.collect_list(F.struct("begin", "end")).alias("at"))
    spans = scratch.write(spans.mapInArrow(_merged, f"id {kind}, d1 long, d2 long, first boolean, begin int, end int"), "spans")
    scratch.drop("found")
    return spans, texts


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, seed: int = SEED, bits: int = BITS, part: int = PART) -> DataFrame:
    """(id, begin int, end int, kept boolean, source): every repeated span of words, [begin, end).

    kept: these passages' first occurrence, which stays. A copy of a text is one span with its representative as source.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    spans, texts = text_spans(docs, scratch, id_col, text_col, passage, seed, bits, part)
    none = F.lit(None).cast(docs.schema[id_col].dataType)
    own = spans.select("id", "begin", "end", F.col("first").alias("kept"), none.alias("source"))
    copied = texts.where("rows > 1").select("d1", "d2", "least")
    rows = docs.select(F.col(id_col).alias("id"), *text_digests(F.col(text_col)), word_count(F.col(text_col)).alias("words")).where(F.col("words") >= passage)
    # of a text with copies, the representative's span is a first occurrence as a whole unless parts of it occur before
    copies = rows.join(copied, ["d1", "d2"]).where(~F.col("id").eqNullSafe(F.col("least"))).select("id", F.lit(0).alias("begin"), F.col("words").alias("end"), F.lit(False).alias("kept"), F.col("least").alias("source"))
    return own.unionByName(copies)


def _cut(at: int, kept: int, least: int):
    """Texts (column number `at`) without the words of their spans, or of copies without all words; white space before a cut word goes with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            out = []
            for text, cuts, copy in zip(*(batch.column(k).to_pylist() for k in (at, kept, kept + 1)), strict=True):
                if text and (cuts or copy):
                    raw = text.encode()
                    data = np.frombuffer(raw, np.uint8)
                    words = Words(data, np.array([0, len(data)]))
                    spans = [(c["begin"], c["end"]) for c in cuts or ()]
                    if copy and len(words.ends) >= least:
                        spans = [(0, len(words.ends))]
                    left, past = [], 0
                    for a, b in sorted(spans):
                        begin = words.ends[a - 1] if a else 0
                        if begin > past:
                            left.append(raw[past:begin])
                        past = max(past, int(words.ends[b - 1]))
                    left.append(raw[past:])
                    text = b"".join(left).decode()
                out.append(text)
            columns = [pa.array(out, batch.schema.field(k).type) if k == at else batch.column(k) for k in range(kept)]
            yield pa.RecordBatch.from_arrays(columns, names[:kept])

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, seed: int = SEED) -> DataFrame:
    """The documents, all columns, without the repeated spans that are not first occurrences; copies become empty.

    Texts without repeats stay byte for byte.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    spans, texts = text_spans(docs, scratch, id_col, text_col, passage, seed)
    cuts = spans.where("not first").groupBy("id", "d1", "d2").agg(F.collect_list(F.struct("begin", "end")).alias("cuts")).select("id", "d1", "d2", "cuts", F.lit(False).alias("copy"))
    rows = docs.select(F.col(id_col).alias("id"), *text_digests(F.col(text_col))).join(texts.where("rows > 1"), ["d1", "d2"])
    copies = rows.where(~F.col("id").eqNullSafe(F.col("least"))).select("id", "d1", "d2", F.lit(None).cast("array<struct<begin:int,end:int>>").alias("cuts"), F.lit(True).alias("copy")).distinct()
    facts = scratch.write(cuts.unionByName(copies), "facts")
    # every document has a key of its own (id and text), so a text that a third of all documents have is no hot key
    names = [f"c{k}" for k in range(len(docs.columns))]
    at, own_id = docs.columns.index(text_col), names[docs.columns.index(id_col)]
    plain = docs.toDF(*names).withColumn(names[at], F.col(names[at]).cast("string"))
    p, f = plain.select("*", *text_digests(F.col(names[at]))).alias("p"), facts.alias("f")
    joined = p.join(f.hint("merge"), (F.col("p.d1") == F.col("f.d1")) & (F.col("p.d2") == F.col("f.d2")) & F.col(f"p.{own_id}").eqNullSafe(F.col("f.id")), "left").select(*[F.col(f"p.{c}") for c in names], "f.cuts", "f.copy")
    schema = ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in names)
    return joined.mapInArrow(_cut(at, len(names), passage), schema).toDF(*docs.columns)
