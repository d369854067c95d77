"""SentencePiece encoding and decoding by a relational lattice.

A text is cut into segments at places that no piece of the vocabulary spans (found from the vocabulary, see
``segment_pattern``), so each distinct segment is encoded once. For each, all substrings of bounded length are exploded
and equi-joined to the piece table; the matches are the edges of the segment's lattice, grouped by segment and folded by
Spark's higher-order ``aggregate``:

* a unigram model takes the best path: the fold is Viterbi over the ends of edges;
* a BPE model's encoding is not a best path of its scores, so there the same fold over the same lattice applies
  merges: each step takes, of the edges that join two current symbols, the one with the best score, the leftmost of
  equals.

Both give the ids of the SentencePiece library, a unigram model up to ties within rounding. A boundary set is one
64-bit mask, so the lattice takes segments of up to ``LONGEST`` characters; the few longer ones (runs of one kind of
character) are encoded by the library itself, so no text is left out.

Texts meet their segments without a join of occurrences. Texts are cut into slices of some megabytes, and a slice is
kept as its table of distinct segments and its texts as numbers in that table. The tables are shuffled once by segment,
which both finds the distinct segments of all slices and joins the lattice's result to each, and once more by slice.
A segment stands at most once a slice, so no key is hot, however frequent the segment.

Defined results: null and empty texts have no ids; characters outside the vocabulary become byte pieces; the character
U+2581 is a space to the model, and decodes to one; repeated rows each get a row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from sluice.llm.common import binaries, give_back, text_ranges

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONGEST = 62
_SPACE_BYTES = SPACE.encode()
#: Text bytes of a slice, text bytes whose segments make a task of the lattice, segments that a worker turns into ids at a time.
SLICE, TASK_BYTES, CODES = 24 << 20, 8 << 20, 1 << 18
#: Beyond so many tasks a shuffle, they grow instead, and spill.
MOST_TASKS = 50_000
#: Distinct segments that a worker holds as Python objects or spells out at a time.
CHUNK = 1 << 16

#: Segments: letters with the spaces before them; one digit; other characters with the spaces before them; spaces.
#: The places for letters that the vocabulary joins to other characters, which count as such, are left open.
FINE = r" *[^\W\d_{0}]+|\d| *(?:[_{0}]|[^\w ])+| +"
COARSE = r" *[^ ]+| +"


@dataclass(frozen=True)
class Vocabulary:
    """A model file's content: pieces with ids and scores, byte pieces, and the model's kind."""

    model: bytes

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read())

    @cached_property
    def _proto(self):
        m = proto.ModelProto()
        m.ParseFromString(self.model)
        return m

    @cached_property
    def is_bpe(self) -> bool:
        return self._proto.trainer_spec.model_type == proto.TrainerSpec.BPE

    @cached_property
    def pieces(self) -> dict[str, tuple[int, float]]:
        """Pieces that text can match: id and score."""
        kinds = proto.ModelProto.SentencePiece
        return {p.piece: (i, p.score) for i, p in enumerate(self._proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for p, (i, _) in self.pieces.items()}

    @cached_property
    def byte_ids(self) -> list[int]:
        own = {p.piece: i for i, p in enumerate(self._proto.pieces)}
        return [own.get(f"<0x{b:02X}>", own.get("<unk>", 0)) for b in range(256)]

    @cached_property
    def spelled(self) -> list[bytes]:
        """The bytes that each id stands for."""
        out = [p.piece.replace(SPACE, " ").encode() for p in self._proto.pieces]
        for i, p in enumerate(self._proto.pieces):
            if p.type == proto.ModelProto.SentencePiece.BYTE:
                out[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type not in (proto.ModelProto.SentencePiece.NORMAL, proto.ModelProto.SentencePiece.USER_DEFINED):
                out[i] = b""
        return out

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @cached_property
    def segment_pattern(self) -> str:
        """The finest of the known cuts that no piece spans; without one, an error."""
        spaced = [p.replace(SPACE, " ") for p in self.pieces]
        spanned = [p for p in spaced if not re.fullmatch(FINE.format(""), p)]
        odd = {c for p in spanned for c in p if re.match(r"[^\W\d_]", c)}
        for pattern in (FINE.format("".join(sorted(odd))), COARSE):
            if all(re.fullmatch(pattern, p) for p in spaced):
                return pattern
        raise ValueError("pieces of this vocabulary span spaces")

    @cached_property
    def library(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def tokens_of_long(self, segment: str) -> list[int]:
        """Ids of a segment beyond the lattice's length, from the library."""
        if segment.startswith(" "):  # the library puts a space before what it is given
            return self.library.encode(segment[1:])
        return self.library.encode("\n" + segment)[2:]  # the space and the line feed, which joins no piece


#: Marks a unit that is a segment already.
_CUT = "\0"


def units(texts: pa.Array, find) -> tuple[pa.Array, np.ndarray]:
    """The texts' parts between single spaces, and each text's number of them.

    Arrow splits texts whose spaces are single and inside; of any other text the segments are units, marked.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.or_(pc.match_substring(texts, SPACE), pc.match_substring(texts, _CUT)))
    odd = pc.or_(odd, pc.equal(texts, "")).to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(pc.if_else(pa.array(~odd), texts, ""), " ")
    if not odd.any():
        return plain.flatten(), pc.list_value_length(plain).to_numpy().astype(np.int64)
    own = {i: [_CUT + s for s in find(" " + texts[i].as_py().replace(SPACE, " "))] if len(texts[i].as_py()) else [] for i in np.flatnonzero(odd)}
    counts = pc.list_value_length(plain).to_numpy().astype(np.int64)
    values, ends = plain.flatten(), np.cumsum(counts)
    parts, at = [], 0
    for i, u in own.items():
        parts += [values.slice(at, ends[i] - counts[i] - at), pa.array(u, pa.large_string())]
        at = ends[i]
        counts[i] = len(u)
    parts.append(values.slice(at))
    return pa.concat_arrays(parts), counts


def segments(unit: str, find) -> list[str]:
    """The segments of a unit."""
    return [unit[1:]] if unit[:1] == _CUT else find(" " + unit)


def _enabling(vocabulary: Vocabulary) -> set[str]:
    """Pieces that are part of one with a better score: merging them may make a better merge possible."""
    score, out = {p: s for p, (_, s) in vocabulary.pieces.items()}, set()
    for p, s in score.items():
        for k in range(1, len(p)):
            x, y = p[:k], p[k:]
            if (k == 1 or x in score) and (k == len(p) - 1 or y in score):
                out.update(f for f in (x, y) if len(f) > 1 and score[f] <= s)
    return out


def _piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """piece, rank (0: the best score; equal scores share one), score, enabling: as many rows as the vocabulary has pieces."""
    order = {s: r for r, s in enumerate(sorted({s for _, s in vocabulary.pieces.values()}, reverse=True))}
    enabling = _enabling(vocabulary) if vocabulary.is_bpe else ()
    rows = [(p, order[s], float(s), int(p in enabling)) for p, (_, s) in vocabulary.pieces.items()]
    return spark.createDataFrame(rows, "piece string, rank long, score double, enabling long")


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _lengths(spark: SparkSession, vocabulary: Vocabulary, least: int) -> DataFrame:
    """prefix, lens: which lengths pieces that begin with ``least`` given characters have. No larger than the vocabulary."""
    lens: dict[str, set[int]] = {}
    for p in vocabulary.pieces:
        if len(p) >= least:
            lens.setdefault(p[:least], {1} if least == 1 else set()).add(len(p))
    return spark.createDataFrame([(p, sorted(n)) for p, n in lens.items()], "prefix string, lens array<int>")


def lattices(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """word and its edges: every substring that is a piece, grouped by word again; a BPE word without any has no row.

    Only places where a piece may begin are joined, and of the substrings from there those are exploded whose length
    some piece with the same first characters has. An edge of a BPE lattice is a number (rank, start, whether it may
    enable a better one), the mask of its ends and the mask of the boundaries inside; of a unigram lattice, stop, start
    and score. Distinct words that are partitioned by word stay so: grouping needs no second shuffle.
    """
    spark, least, n = words.sparkSession, 3 if vocabulary.is_bpe else 1, F.length("word")
    pieces, lengths = F.broadcast(_piece_table(spark, vocabulary)), F.broadcast(_lengths(spark, vocabulary, least))  # both bounded by the vocabulary
    # the hash goes first: sorting by a number is far quicker than by a text
    starts = words.select(F.xxhash64("word").alias("key"), "word", F.explode(F.when(n >= min(least, 2), F.sequence(F.lit(0), n - min(least, 2)))).alias("start"))
    probed = starts.withColumn("prefix", F.expr(f"substring(word, start + 1, {least})")).join(lengths, "prefix", "left")
    lens = F.when(F.col("lens").isNull(), F.array(F.lit(min(least, 2)))).otherwise(F.concat(F.array(F.lit(2)), "lens") if vocabulary.is_bpe else F.col("lens"))
    cut = probed.select("key", "word", "start", F.explode(lens).alias("len")).where(F.col("start") + F.col("len") <= n).withColumn("piece", F.expr("substring(word, start + 1, len)"))
    if vocabulary.is_bpe:
        first, size = F.col("start"), F.col("len")
        edge = F.struct(
            (F.col("rank") * (1 << 16) + first * (1 << 8) + F.col("enabling")).alias("order"),
            (_bit(first) + _bit(first + size)).alias("ends"),
            F.call_function("shiftleft", _bit(size - 1) - 1, first + 1).alias("inner"),
        )
        return cut.join(pieces, "piece").groupBy("key", "word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    unknown = min(s for _, s in vocabulary.pieces.values()) - 10.0
    known = cut.join(pieces, "piece", "left").where(F.col("rank").isNotNull() | (F.col("len") == 1))
    edge = F.struct((F.col("start") + F.col("len")).alias("stop"), F.col("start"), F.coalesce("score", F.lit(unknown)).alias("score"))
    return known.groupBy("key", "word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _all_bits(n: Column) -> Column:
    """Bits 0 to n, the boundaries of all characters; bit 63 would overflow."""
    return (_bit(n) - 1) * 2 + 1


def merged(n: Column, edges: Column) -> Column:
    """The boundary mask after all merges: folds in which each merge is the best that is possible then.

    Edges come sorted, the best first. One pass over them applies each edge that joins two symbols. That is exact unless
    a merge makes a better edge possible than itself, which only pieces can that are part of a better one; such words
    are folded step by step instead, each step searching all edges.
    """
    full = _all_bits(n)

    def joins(mask: Column, e: Column) -> Column:
        return (F.bit_count(mask.bitwiseAND(e["inner"])) == 1) & (mask.bitwiseAND(e["ends"]) == e["ends"])

    def one_pass(state: Column, e: Column) -> Column:
        after = state["mask"].bitwiseAND(F.bitwise_not(e["inner"]))
        better = (e["order"].bitwiseAND(1) == 1) & F.exists(edges, lambda f: (f["order"] < e["order"]) & joins(after, f))
        return F.when(joins(state["mask"], e), F.struct(after.alias("mask"), (state["again"] | better).alias("again"))).otherwise(state)

    def one_step(mask: Column, _: Column) -> Column:
        best = F.get(F.filter(edges, lambda e: joins(mask, e)), F.lit(0))
        return F.coalesce(mask.bitwiseAND(F.bitwise_not(best["inner"])), mask)

    def settled(state: Column) -> Column:
        steps = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), full, one_step)
        return F.when(state["again"], steps).otherwise(state["mask"])

    return F.aggregate(edges, F.struct(full.alias("mask"), F.lit(False).alias("again")), one_pass, settled)


def viterbi(n: Column, edges: Column) -> Column:
    """The boundary mask of the best path: a fold over stops, each with its best score and that path's mask.

    Of equal scores the longer last piece wins, as in the library.
    """
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.lit(1).cast("long").alias("mask")))

    def step(best: Column, stop: Column) -> Column:
        here = F.transform(
            F.filter(edges, lambda e: e["stop"] == stop),
            lambda e: F.struct(
                (F.get(best, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("back"), (F.get(best, e["start"])["mask"] + _bit(stop)).alias("mask")
            ),
        )
        return F.concat(best, F.array(F.array_max(here)))

    return F.aggregate(F.sequence(F.lit(1), n), first, step, lambda best: F.element_at(best, -1)["mask"])


def boundaries(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """word and mask of distinct ``words`` (of 1 to LONGEST characters, spaces as the vocabulary writes them) that have edges."""
    n, graphs = F.length("word"), lattices(words, vocabulary)
    fold = merged if vocabulary.is_bpe else viterbi
    return graphs.select("word", fold(n, F.col("edges")).alias("mask"))


def _picked(codes: np.ndarray, start: np.ndarray, size: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``pool`` that ``codes`` name, one after the other, and each one's length."""
    n = size[codes]
    return pool[np.repeat(start[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


class Slice:
    """The segments of some texts: each distinct one has a code, frequent ones the low codes."""

    def __init__(self, texts: pa.Array, find):
        all_units, n_units = units(texts, find)
        named = all_units.dictionary_encode()
        unit = named.indices.to_numpy(zero_copy_only=False)
        names = named.dictionary
        del all_units, named
        sizes, parts = [np.zeros(0, np.int32)], [pa.array([], pa.large_string())]
        for c in range(0, len(names), CHUNK):
            found = [segments(u, find) for u in names.slice(c, CHUNK).to_pylist()]
            sizes.append(np.fromiter(map(len, found), np.int32, len(found)))
            parts.append(pa.array([s for p in found for s in p], pa.large_string()))
        size, spelled = np.concatenate(sizes), pa.concat_arrays(parts).dictionary_encode()
        del names, parts
        seq = spelled.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(size[unit], dtype=np.int64)
        self.ends = np.concatenate([[0], ends])[np.cumsum(n_units)]
        # a unit's segments follow one another in seq
        at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        at -= np.repeat((ends - size[unit] - _starts(size)[unit]).astype(np.int32), size[unit])
        seq = seq[at]
        order = np.argsort(-np.bincount(seq, minlength=len(spelled.dictionary)), kind="stable")
        code = np.empty(len(order), np.int32)
        code[order] = np.arange(len(order), dtype=np.int32)
        self.words = pc.replace_substring(spelled.dictionary.take(pa.array(order)), " ", SPACE)
        self.codes = code[seq]


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: most high bytes are 0."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _sliced(docs: DataFrame, pattern: str, slice_bytes: int) -> DataFrame:
    """slice, packed: one row for each slice of texts, with all that its texts' ids depend on but the segments' masks.

    Packed are the texts' ids and hashes, where each one's codes end, the codes, and the distinct segments by code.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, pack, nth = re.compile(pattern).findall, zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        for rb in batches:
            for a, b in text_ranges(rb.column("text"), slice_bytes):
                texts, ids = rb.column("text").slice(a, b - a), rb.column("doc_id").slice(a, b - a)
                whole = np.array([xxhash.xxh3_64_intdigest((t or b"").replace(_SPACE_BYTES, b" ")) for t in binaries(texts)], np.uint64)
                own = Slice(texts, find)
                known = pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), whole
                packed = pack.compress(pickle.dumps((*known, _planes(own.ends), _planes(own.codes), own.words.to_pylist())))
                del texts, ids, whole, own, known
                yield pa.RecordBatch.from_arrays([pa.array([nth]), pa.array([packed])], names=["slice", "packed"])
                del packed
                give_back()
                nth += 1

    return docs.mapInArrow(run, "slice long, packed binary")


def _named(sliced: DataFrame) -> DataFrame:
    """word, slice, code: the distinct segments of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for rb in batches:
            for nth, packed in zip(rb.column("slice").to_pylist(), rb.column("packed")):
                words = pickle.loads(unpack.decompress(packed.as_py()))[-1]
                for c in range(0, len(words), 1 << 16):
                    some = pa.array(words[c : c + (1 << 16)], pa.string())
                    yield pa.RecordBatch.from_arrays([some, pa.array(np.full(len(some), nth)), pa.array(np.arange(c, c + len(some), dtype=np.int32))], names=["word", "slice", "code"])
                del words, packed
                give_back()

    return sliced.mapInArrow(run, "word string, slice long, code int")


class Coder:
    """Ids of a slice's texts on a worker, from its segments' masks."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        names, ids = zip(*sorted(vocabulary.ids.items()))
        self.names, self.ids = pa.array(names, pa.large_string()).cast(pa.large_binary()), np.array(ids, np.int32)
        self.bytes = np.array(vocabulary.byte_ids, np.int32)
        self.spelled = pa.array(vocabulary.spelled, pa.large_binary())

    def tokens(self, words: list[str], masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some segments one after the other, and how many each has; a segment is its tokens, so its bytes are theirs."""
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        chars = np.flatnonzero((raw & 0xC0) != 0x80)
        first = np.cumsum([0, *map(len, words)])
        owner = np.repeat(np.arange(len(words)), np.diff(first))
        cut = (masks[owner] >> (np.arange(len(chars)) - first[owner])) & 1 == 1
        start, owner = chars[cut], owner[cut]
        offsets = np.append(start, len(raw)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        found = pc.fill_null(pc.index_in(pieces, value_set=self.names), -1).to_numpy(zero_copy_only=False)
        size = np.where(found < 0, np.diff(offsets), 1)
        out = np.repeat(np.where(found < 0, -1, self.ids[found]), size)
        out[out < 0] = self.bytes[raw[np.repeat(found < 0, np.diff(offsets))]]
        return out.astype(np.int32), np.bincount(owner, size, len(words)).astype(np.int64)

    def table(self, words: list[str], masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each segment's ids start in a pool, how many they are, and the pool."""
        sizes, pools = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for c in range(0, len(words), CHUNK):
            some, mask = words[c : c + CHUNK], masks[c : c + CHUNK]
            pool, n = self.tokens(["" if m == 0 else w for w, m in zip(some, mask.tolist())], mask)
            sizes.append(n)
            pools.append(pool)
        size, start, n = np.concatenate(sizes), _starts(np.concatenate(sizes)), sum(map(len, pools))
        for c in np.flatnonzero(masks == 0):
            pools.append(np.array(self.vocabulary.tokens_of_long(words[c].replace(SPACE, " ")), np.int32))
            size[c], start[c] = len(pools[-1]), n
            n += len(pools[-1])
        return start, size, np.concatenate(pools)

    def texts(self, codes: np.ndarray, ends: np.ndarray, whole: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """The ids of some texts, how many each has, and whether they spell it, from its codes up to each of ``ends``."""
        ids, n = _picked(codes, *table)
        at = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends])]
        spelled = self.spelled.take(pa.array(ids))
        offsets = np.frombuffer(spelled.buffers()[1], np.int64)[at] if len(ids) else np.zeros(len(at), np.int64)
        raw = memoryview(spelled.buffers()[2] or b"")
        same = [xxhash.xxh3_64_intdigest(raw[x + (raw[x : x + 1] == b" ") : y]) == w for x, y, w in zip(offsets[:-1].tolist(), offsets[1:].tolist(), whole.tolist())]
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), np.diff(at), pa.array(same, pa.bool_())


def _spelling(ids: Sequence[int], spelled: Sequence[bytes]) -> bytes:
    return b"".join(map(spelled.__getitem__, ids)).removeprefix(b" ")


def decode(ids: Sequence[int], spelled: Sequence[bytes]) -> str:
    """The text of some ids: pieces joined, without the space that encoding put first."""
    return _spelling(ids, spelled).decode(errors="replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (whether decoding gives the text again) for each row.

    Texts are cut into slices of about ``slice_bytes``, each with its own table of distinct segments. Those tables meet
    the lattice's result by segment and go back by slice. Only the model's pieces are broadcast, and nothing is collected.
    """
    spark, model, pattern = docs.sparkSession, vocabulary.model, vocabulary.segment_pattern
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # the shuffles below are each used twice, with the same columns and filters (those that joins add too), so that they
    # are made once
    # by a number of partitions, which adaptive execution leaves alone: a few slices a task, and a segment's lattice is far
    # larger than its row
    tasks = lambda n: min(MOST_TASKS, max(spark.sparkContext.defaultParallelism, -(-size // n)))
    by_slice = tasks(max(2 * slice_bytes, TASK_BYTES))
    sliced = _sliced(rows, pattern, slice_bytes).repartition(by_slice, "slice")
    dealt = _named(sliced).where(F.col("word").isNotNull() & F.col("slice").isNotNull() & (F.length("word") <= LONGEST)).repartition(tasks(TASK_BYTES), "word")
    words = dealt.groupBy("word").agg(F.min("slice").alias("s"), F.min("code").alias("c")).where("s >= 0 AND c >= 0").select("word")
    known = dealt.join(boundaries(words, vocabulary).hint("shuffle_hash"), "word", "left")
    # a segment without edges falls into its characters
    masks = known.select("slice", "code", F.coalesce("mask", _all_bits(F.length("word"))).alias("mask"))
    # dealt as the slices are: with another number of partitions the join would shuffle the slices anew
    grouped = masks.repartition(by_slice, "slice").groupBy("slice").agg(F.collect_list("code").alias("known"), F.collect_list("mask").alias("masks"))  # bounded by a slice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, unpack = Coder(Vocabulary(model)), zstandard.ZstdDecompressor()
        for rb in batches:
            for i in range(rb.num_rows):
                doc_ids, absent, whole, ends, codes, words = pickle.loads(unpack.decompress(rb.column("packed")[i].as_py()))
                masks = np.zeros(len(words), np.int64)  # 0 stands for a segment that is too long for a mask
                if rb.column("known")[i].is_valid:
                    masks[rb.column("known")[i].values.to_numpy()] = rb.column("masks")[i].values.to_numpy()
                table, ends, codes = coder.table(words, masks), _unplaned(ends).astype(np.int64), _unplaned(codes)
                del words, masks
                a, lists, n, same = 0, None, None, None
                while a < len(ends):  # some texts at a time; a longer one by itself
                    first = int(ends[a - 1]) if a else 0
                    b = max(a + 1, int(np.searchsorted(ends, first + CODES, side="right")))
                    lists, n, same = coder.texts(codes[first : ends[b - 1]], ends[a:b] - first, whole[a:b], table)
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], mask=absent[a:b]), lists, pa.array(n), same], names=["doc_id", "ids", "n_tokens", "round_trip"])
                    a = b
                del doc_ids, absent, whole, ends, codes, table, lists, n, same
                give_back()

    return sliced.join(grouped, "slice", "left").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decoded(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` with a column text: what its ids spell."""
    model = vocabulary.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = Vocabulary(model).spelled
        for rb in batches:
            texts = [None if ids is None else decode(ids, spelled) for ids in rb.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(texts, pa.string())], names=[*rb.schema.names, "text"])

    return encoded.mapInArrow(run, encoded.select("*", F.lit("").alias("text")).schema)
