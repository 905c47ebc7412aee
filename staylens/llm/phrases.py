"""Removal of repeated passages with sharded automata of phrases.

A window is ``WINDOW`` consecutive words of one text. Every window has an anchor: the gram of
``GRAM`` words in it with the least hash. Neighbouring windows mostly share their anchor;
such a piece of text is what is counted and shuffled, about one row for seven words.

1. Anchors are counted. A window that recurs has an anchor that recurs, so pieces with any
   other anchor are done with.
2. Equal pieces of all documents are counted and the first place of each is found; then the
   windows of the distinct pieces are counted. Those that occur at least twice are confirmed,
   each with the first place where it stands.
3. Confirmed windows are dealt to shards by anchor. A task compiles the windows of a shard
   into one Aho-Corasick automaton whose letters are words, and streams every distinct piece
   with an anchor of that shard through it.
4. The matches of a piece hold at all its places, whatever their number, and go there by an
   equality join. Each match that is not the window's first place removes the words it covers.

A shard with many pieces is streamed by several tasks, each with its copy of the automaton;
one with many phrases is cut into several automata that all see its pieces. So no task
holds more than ``UNIT_PHRASES`` phrases, whatever the anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.llm.common import bound_batches, drop, lookup, sized, store, text_or_empty, tidy

WINDOW = 20
GRAM = 6
# Bytes of text whose words a task holds at a time, unless one text has more.
SLICE_BYTES = 2 * 1024 * 1024
# Phrases of one automaton, and pieces that one task streams through it.
UNIT_PHRASES = 8_192
UNIT_PIECES = 100_000
MOST_TASKS = 20_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_HIGH = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    return (x ^ (x >> np.uint64(29))) * _ODD


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbours."""
    width = 1
    while 2 * width <= span:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    rest = span - width
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


class _Pieces:
    """The pieces of a batch of texts: windows in a row that share their anchor.

    For piece i: ``doc[i]`` the number of its text, ``at[i]`` its first window, ``size[i]`` the number
    of its windows, ``anchor[i]`` and ``key[i]`` hashes of the anchor and of the whole piece;
    ``hashes[first[i]:first[i] + size[i]]`` are the hashes of its windows.
    """

    def __init__(self, texts: pa.Array) -> None:
        self.words = [t.as_py().encode("utf-8", "replace").split() for t in texts]
        counts = np.array([len(w) for w in self.words], np.int64)
        n = int(counts.sum())
        self.doc = self.at = self.size = self.first = np.zeros(0, np.int64)
        self.anchor = self.key = self.hashes = np.zeros(0, np.uint64)
        if n < WINDOW:
            return
        word = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(self.words)), np.uint64, n)
        gram = np.zeros(n - GRAM + 1, np.uint64)
        for j in range(GRAM):
            gram = _mix(gram ^ word[j : n - GRAM + 1 + j])
        # upper half of the hash, then position: of equal grams the first one, in every copy alike
        keys = (gram >> _HIGH << _HIGH) | np.arange(len(gram), dtype=np.uint64)
        chosen = _least(keys, WINDOW - GRAM + 1)
        ends = np.cumsum(counts)
        text = np.repeat(np.arange(len(counts)), counts)[: len(chosen)]
        place = np.arange(len(chosen))
        whole = place + WINDOW <= ends[text]
        place, text, chosen = place[whole], text[whole], chosen[whole]
        if not len(place):
            return
        spot = (chosen & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(place), bool)
        new[1:] = (spot[1:] != spot[:-1]) | (text[1:] != text[:-1])
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(place)))
        self.doc = text[self.first]
        self.at = place[self.first] - (ends - counts)[self.doc]
        self.anchor = gram[spot[self.first]]
        # grams from several places cover a window
        hashes = _mix(gram[place])  # mixed, or equal grams would cancel out
        for j in [*range(GRAM, WINDOW - GRAM, GRAM), WINDOW - GRAM]:
            hashes = _mix(hashes ^ gram[place + j])
        self.hashes = hashes
        self.key = np.add.reduceat(_mix(self.hashes), self.first) ^ self.size.astype(np.uint64)

    def text(self, i: int) -> str:
        at = self.at[i]
        return b" ".join(self.words[self.doc[i]][at : at + self.size[i] + WINDOW - 1]).decode("utf-8")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of (id, row, text, ...) in slices of so many bytes of text."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64)) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
        for low, high in pairwise(edges):
            yield batch.slice(low, high - low)


def _places(docs: DataFrame) -> DataFrame:
    """(id, row, anchor, key, at): a row per piece, from (id, row, text)."""
    schema = T.StructType([
        docs.schema["id"], T.StructField("row", T.LongType()), T.StructField("anchor", T.LongType()), T.StructField("key", T.LongType()),
        T.StructField("at", T.IntegerType()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = _Pieces(batch.column(2))
            doc = pa.array(found.doc)
            numbers = [pa.array(found.anchor.view(np.int64)), pa.array(found.key.view(np.int64)), pa.array(found.at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), *numbers], names=schema.names)

    return docs.mapInArrow(work, schema)


def _spot(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (doc.astype(np.int64) << 32) + at


def _cut(marked: DataFrame) -> DataFrame:
    """(id, row, at, anchor, key, text, n, hashes): the marked pieces of (id, row, text, marks).

    A mark is the place of a piece and how often the piece occurs; ``hashes`` are those of its windows.
    """
    schema = T.StructType([
        marked.schema["id"], T.StructField("row", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("anchor", T.LongType()),
        T.StructField("key", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.LongType()),
        T.StructField("hashes", T.ArrayType(T.LongType())),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = _Pieces(batch.column(2))
            marks, doc = batch.column(3), np.arange(batch.num_rows)
            mark_doc = np.repeat(doc, marks.value_lengths().to_numpy())
            mark = marks.flatten()
            # pieces are in order of text and place
            wanted = np.searchsorted(_spot(found.doc, found.at), _spot(mark_doc, mark.field("at").to_numpy()))
            size = found.size[wanted]
            ends = np.cumsum(size)
            windows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(found.first[wanted] - (ends - size), size)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            rows = pa.array(mark_doc)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows), mark.field("at").cast(pa.int32()),
                    pa.array(found.anchor[wanted].view(np.int64)), pa.array(found.key[wanted].view(np.int64)),
                    pa.array(map(found.text, wanted.tolist()), pa.string()), mark.field("n"),
                    pa.ListArray.from_arrays(offsets, pa.array(found.hashes[windows].view(np.int64))),
                ], names=schema.names,
            )

    return marked.mapInArrow(work, schema)


def _same_row(a: DataFrame, b: DataFrame, how: str, *more: str) -> DataFrame:
    """Join two tables on (id, row), where a missing id equals a missing id."""
    other = b.withColumnsRenamed({c: f"_other_{c}" for c in ("id", "row", *more)})
    on = a["id"].eqNullSafe(other["_other_id"])
    for c in ("row", *more):
        on = on & (a[c] == other[f"_other_{c}"])
    return a.join(other, on, how).drop(*[f"_other_{c}" for c in ("id", "row", *more)])


def _confirmed(pieces: DataFrame) -> DataFrame:
    """(anchor, id, row, at, offsets): pieces in which confirmed windows have their first place, and where these start."""
    windows = pieces.select("anchor", "id", "row", "at", "n", F.posexplode("hashes").alias("offset", "hash"))
    place = F.struct("id", "row", (F.col("at") + F.col("offset")).alias("start"), "offset")
    confirmed = windows.groupBy("anchor", "hash").agg(F.sum("n").alias("n"), F.min(place).alias("p")).where("n > 1")
    first = confirmed.select("anchor", "p.id", "p.row", (F.col("p.start") - F.col("p.offset")).alias("at"), "p.offset")
    return first.groupBy("anchor", "id", "row", "at").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))


class _Automaton:
    """The confirmed windows of a unit; a word is a letter of the automaton's alphabet.

    Confirmed windows in a row share the words in their middle. One pattern for these stands
    for all of them; around its matches the words are compared with those of the phrase, as far as
    its windows reach. So a phrase costs the letters of one pattern, not of a pattern per window.
    """

    def __init__(self) -> None:
        self.letters: dict[str, str] = {}
        self.found = ahocorasick.Automaton()

    def _letter(self, word: str) -> str:
        letter = self.letters.get(word)
        if letter is None:
            code = len(self.letters) + 2
            # surrogates are no characters; a unit has far fewer words than there are characters
            letter = self.letters[word] = chr(code if code < 0xD800 else code + 0x800)
        return letter

    def add(self, text: str, offsets: list[int], id_, row: int, at: int) -> None:
        spelled = "".join(map(self._letter, text.split(" ")))
        first = 0
        for i, k in enumerate(offsets):
            if i + 1 < len(offsets) and offsets[i + 1] == k + 1:
                continue
            low, more = offsets[first], k - offsets[first]
            phrase = (spelled[low : k + WINDOW], more, (id_, row), at + low)
            middle = spelled[k : low + WINDOW]
            known = self.found.get(middle, None)
            if known is None:
                self.found.add_word(middle, [phrase])
            else:
                known.append(phrase)
            first = i + 1

    def compile(self) -> None:
        self.found.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, tuple, int]]:
        """Windows (first, last, row, place): those from first to last stand in a row from a place on at first."""
        get = self.letters.get
        spelled = "".join([get(w, "\x01") for w in text.split(" ")])
        out = []
        for end, phrases in self.found.iter(spelled):
            for words, more, row, place in phrases:
                start = end + 1 - WINDOW  # of the phrase, whose pattern ends with its first window
                low, high = 0, len(words)
                if start < 0 or not spelled.startswith(words, start):
                    low, high = more, WINDOW
                    while low and start + low > 0 and words[low - 1] == spelled[start + low - 1]:
                        low -= 1
                    while high < len(words) and start + high < len(spelled) and words[high] == spelled[start + high]:
                        high += 1
                    if high - low < WINDOW:
                        continue
                out.append((start + low, start + high - WINDOW, row, place + low))
        return out


class _Spans:
    """Lists of words [low, high), as columns."""

    def __init__(self) -> None:
        self.low: list[int] = []
        self.high: list[int] = []
        self.offsets = [0]

    def add(self, windows: list[tuple[int, int]]) -> None:
        """The words that windows from the first to the last of each pair cover."""
        begin = len(self.low)
        for first, last in sorted(windows):
            if len(self.low) > begin and first <= self.high[-1]:
                self.high[-1] = max(self.high[-1], last + WINDOW)
            else:
                self.low.append(first)
                self.high.append(last + WINDOW)
        self.offsets.append(len(self.low))

    def array(self) -> pa.ListArray:
        struct = pa.StructArray.from_arrays([pa.array(self.low, pa.int32()), pa.array(self.high, pa.int32())], names=["low", "high"])
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), struct)


_SPANS = T.ArrayType(T.StructType([T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())]))


def _stream(units: DataFrame) -> DataFrame:
    """(anchor, key, id, row, at, own, others): the words of each piece to remove at its first place and at others.

    A unit has its phrases, which have offsets, before its pieces. Words count from the start of the piece.
    """
    first = ["anchor", "key", "id", "row", "at"]
    schema = T.StructType([*[units.schema[c] for c in first], T.StructField("own", _SPANS), T.StructField("others", _SPANS)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, automaton, ready = None, _Automaton(), False
        for batch in batches:
            hits, own, others = [], _Spans(), _Spans()
            cells = (batch.column(c).to_pylist() for c in ("unit", "id", "row", "at", "text", "offsets"))
            for i, (key, id_, row, at, text, offsets) in enumerate(zip(*cells)):
                if key != unit:
                    automaton = None  # the old one goes before the new one grows
                    unit, automaton, ready = key, _Automaton(), False
                if offsets is not None:
                    automaton.add(text, offsets, id_, row, at)
                    continue
                if not automaton.letters:
                    continue
                if not ready:
                    automaton.compile()
                    ready = True
                found = automaton.matches(text)
                if found:
                    hits.append(i)
                    others.add([(a, b) for a, b, _, _ in found])
                    # a match is the window's first place when it stands there in the same row
                    own.add([(a, b) for a, b, where, place in found if where != (id_, row) or place != at + a])
            columns = [batch.column(c).take(pa.array(hits, pa.int64())) for c in first]
            yield pa.RecordBatch.from_arrays([*columns, own.array(), others.array()], names=schema.names)

    return units.select("unit", *first, "text", "offsets").mapInArrow(work, schema)


def _units(pieces: DataFrame, unit_phrases: int, unit_pieces: int, limit: int | None) -> DataFrame:
    """Phrases, which are pieces with offsets, and all pieces dealt to units, the phrases of a unit first."""
    phrases = pieces.where("offsets is not null")
    shards = max(1, -(-phrases.count() // unit_phrases))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    load = pieces.groupBy(shard).agg(F.count(F.lit(1)).alias("pieces"), F.count("offsets").alias("phrases")).where("phrases > 0")
    # twice the mean is no reason to cut an automaton in two
    parts = F.ceil(F.col("phrases") / (2 * unit_phrases))
    load = sized(load.select("shard", parts.alias("parts"), F.ceil(F.col("pieces") / unit_pieces).alias("copies")), limit)
    own = ["id", "row", "at", "anchor", "text"]
    mixed = F.xxhash64("id", "row", "at")
    dealt = lookup(phrases.select(shard, *own, "offsets"), load, ["shard"], "inner").select(
        "shard", F.pmod(mixed, F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), *own,
        F.lit(None).cast("long").alias("key"), "offsets",
    )
    streamed = lookup(pieces.select(shard, *own, "key"), load, ["shard"], "inner").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.pmod(mixed, F.col("copies")).alias("copy"), *own, "key",
        F.lit(None).cast("array<int>").alias("offsets"),
    )
    rows = dealt.unionByName(streamed).withColumn("unit", F.xxhash64("shard", "part", "copy"))
    # by number, since the work of a unit is not in proportion to its bytes
    units = load.df.agg(F.sum(F.col("parts") * F.col("copies"))).first()[0] or 1
    return rows.repartition(min(units, MOST_TASKS), "unit").sortWithinPartitions("unit", F.col("offsets").isNull())


def repeated_words(
    docs: DataFrame, unit_phrases: int = UNIT_PHRASES, unit_pieces: int = UNIT_PIECES, limit: int | None = None
) -> DataFrame:
    """(id, row, spans): words [low, high) of each document that repeat an earlier window, from (id, row, text).

    The table is stored.
    """
    places = store(_places(docs))
    anchors = store(places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    tidy(docs.sparkSession)
    known = store(places.join(anchors, "anchor", "left_semi"))
    drop(places, anchors)
    first = F.min(F.struct("id", "row", "at")).alias("p")
    marks = known.groupBy("anchor", "key").agg(F.count(F.lit(1)).alias("n"), first).select("p.*", "n")
    marks = store(marks.groupBy("id", "row").agg(F.collect_list(F.struct("at", "n")).alias("marks")))
    cut = store(_cut(_same_row(docs, marks, "inner").select("id", "row", "text", "marks")))
    drop(marks)
    offsets = store(_confirmed(cut))
    tidy(docs.sparkSession)
    # phrases are the pieces with offsets
    pieces = store(_same_row(cut.select("id", "row", "at", "anchor", "key", "text"), offsets, "left", "at", "anchor"))
    drop(cut, offsets)
    matches = store(_stream(_units(pieces, unit_phrases, unit_pieces, limit)))
    drop(pieces)
    found = store(_removed(known, matches))
    drop(known, matches)
    return found


def _removed(places: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, row, spans): the words that the matches of pieces cover at all places of these."""
    side = matches.withColumnsRenamed({c: f"_first_{c}" for c in ("id", "row", "at")})
    joined = places.join(side, ["anchor", "key"])
    is_first = F.col("id").eqNullSafe(F.col("_first_id")) & (F.col("row") == F.col("_first_row")) & (F.col("at") == F.col("_first_at"))
    spans = F.when(is_first, F.col("own")).otherwise(F.col("others"))
    moved = F.transform(spans, lambda x: F.struct((x["low"] + F.col("at")).alias("low"), (x["high"] + F.col("at")).alias("high")))
    moved = joined.select("id", "row", moved.alias("spans")).where(F.size("spans") > 0)
    return moved.groupBy("id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def drop_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts: bool = True,
    digests: bool = False,
    unit_phrases: int = UNIT_PHRASES,
    unit_pieces: int = UNIT_PIECES,
    limit: int | None = None,
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed`` and ``kept_text``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged. A word goes when a window of 20
    words covers it whose words also start earlier: in a row of a smaller id, or earlier in the
    same row. Windows are judged on the input, not on what is left. ``kept_text`` has the other
    words joined by one space. Missing and empty texts have no words; a text of fewer than 20
    words loses none. Rows with equal id and text are one document and lose the same words; rows
    that share an id and not the text are ordered by a hash of theirs; a missing id comes before
    all others. Other columns are not read. ``texts=False`` leaves the text out, ``digests=True`` adds its
    SHA-256. Windows are told apart by 128 bits of hashes until they are confirmed, matched
    word by word after that.
    """
    bound_batches(docs.sparkSession)
    id_ = F.col(f"`{id_col}`")
    source = docs.select(id_.alias("id"), F.xxhash64(id_, text_or_empty(text_col)).alias("row"), text_or_empty(text_col).alias("text"))
    spans = repeated_words(source, unit_phrases, unit_pieces, limit)
    fields = [source.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    fields += [T.StructField("kept_text", T.StringType())] if texts else []
    fields += [T.StructField("kept_sha256", T.StringType())] if digests else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, left, sums = [], [], [], []
            spans = batch.column(2)
            many = np.cumsum(np.concatenate([[0], spans.value_lengths().fill_null(0).to_numpy()])).tolist()
            flat = spans.flatten()
            low, high = (flat.field(c).to_pylist() for c in ("low", "high"))
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.encode("utf-8", "replace").split()
                sizes.append(len(words))
                if many[i] < many[i + 1]:
                    stay = bytearray(b"\1") * len(words)
                    for k in range(many[i], many[i + 1]):
                        stay[low[k] : high[k]] = bytes(high[k] - low[k])
                    words = [*compress(words, stay)]
                gone.append(sizes[-1] - len(words))
                kept = b" ".join(words)
                if texts:
                    left.append(kept.decode("utf-8"))
                if digests:
                    sums.append(hashlib.sha256(kept).hexdigest())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())]
            columns += [pa.array(left, pa.string())] if texts else []
            columns += [pa.array(sums, pa.string())] if digests else []
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    joined = _same_row(source, spans, "left").select("id", "text", "spans")
    return joined.mapInArrow(work, T.StructType(fields)).withColumnRenamed("id", id_col)
