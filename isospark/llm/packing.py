"""Packing documents into sequences: shortest-pack-first over the histogram of lengths.

The planner sees only how many pieces have each length, a table of at most `capacity` rows at
any input size. It gives packing patterns and how often each is used; a piece finds its
pattern by its rank among the pieces of its length.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isospark.llm.common import held, map_slices, ranked, stage
from isospark.llm.pretokens import utf8, white_chunks

VOCABULARY = "word_bpe_49k.json"
END = 2
#: Pieces of one length are dealt to this many buckets at least, to more where a bucket would have over so many pieces.
LEAST_BUCKETS, PER_BUCKET = 64, 250_000
#: Sequences that would be filled less are made of one stream of pieces, cut where a sequence is full.
LEAST_FILL = 0.99


class WordIds:
    """Ids by the tokenizers library, kept by chunk.

    The tokenizer drops white space and looks at nothing across it, and parts letters from
    marks, so text is cut there and each chunk is encoded once. ASCII letters are lower-cased
    first, as the tokenizer does, unless a capital one may compose with what follows it. Chunks
    that are one word each go to the library in rows. Long chunks are cut before digits, of which each is a word of its own. Texts that may hold a
    special string are encoded whole.
    """

    #: Chunks kept, and how long they may be; bytes that the library is given at a time, and of a chunk that is cut; words in a row.
    KEEP, LONGEST, GIVEN, CUT, ROW = 600_000, 48, 1 << 20, 1 << 16, 256
    #: Letters that neither compose nor come apart, nor do so as small ones: a chunk of them is one word.
    WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        suffix, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _long(self, chunk: str) -> bytes:
        parts, start = [], 0
        while start < len(chunk):
            digit = re.compile(r"[0-9]").search(chunk, start + self.CUT)
            end = digit.start() if digit else len(chunk)
            parts.append(chunk[start:end])
            start = end
        return b"".join(x for p in parts for x in self._library([p]))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of chunks that are one word each: of each word's tokens the last one, and no other, has the suffix of word ends."""
        rows = [" ".join(words[i : i + self.ROW]) for i in range(0, len(words), self.ROW)]
        data = b"".join(self._library(rows))
        ends = 4 * (np.flatnonzero(self.last[np.frombuffer(data, np.int32)]) + 1)
        if len(ends) != len(words):  # a vocabulary without such a suffix
            return self._library(words)
        cuts = [0, *ends.tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _all(self, chunks: list[str]) -> list[bytes]:
        """Ids of each of `chunks`, which differ, by the library for those that are not kept."""
        if len(self.known) > self.KEEP:
            self.known.clear()
        out = list(map(self.known.get, chunks))
        words, others = [], []
        for i in (i for i, ids in enumerate(out) if ids is None):
            if len(chunks[i]) > self.CUT:
                out[i] = self._long(chunks[i])
            else:
                (words if self.WORD.fullmatch(chunks[i]) else others).append(i)
        for part, encode in ((words, self._words), (others, self._library)):
            start = size = 0
            for k, i in enumerate(part, 1):
                size += len(chunks[i]) + 64
                if size > self.GIVEN or k == len(part):
                    given = [chunks[j] for j in part[start:k]]
                    for j, c, ids in zip(part[start:k], given, encode(given), strict=True):
                        out[j] = ids
                        if len(c) <= self.LONGEST:
                            self.known[c] = ids
                    start, size = k, 0
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        texts = utf8(texts)
        special = pc.match_substring(texts, "<|")
        lower = pc.if_else(pc.match_substring_regex(texts, r"[A-Z]\p{M}"), texts, pc.ascii_lower(texts))
        chunks = white_chunks(pc.if_else(special, pa.scalar("", texts.type), lower))
        ids, ends = chunks.joined(self._all(chunks.unique))
        data, cuts = ids.tobytes(), np.append(0, 4 * ends).tolist()
        out = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)):
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32).tobytes()
        return out


def _ids(path: str) -> WordIds:
    """One for each Python worker, with what it has kept."""
    return held(("packing", path), lambda: WordIds(path))


def tokenized_pieces(docs: DataFrame, capacity: int = 4096, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids binary) of the pieces of each row of `docs`.

    A document is its ids and then `end`; null and empty texts are `end` alone. Documents over
    `capacity` are cut into whole sequences and a rest. `ids` is little-endian 32-bit.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = _ids(path), np.array([end], np.int32).tobytes()
        for batch in batches:
            at, starts, totals, pieces = [], [], [], []
            for i, ids in enumerate(words.encode(batch.column(1))):
                ids += last
                for s in range(0, len(ids), 4 * capacity):
                    at.append(i)
                    starts.append(s // 4)
                    totals.append(len(ids) // 4)
                    pieces.append(ids[s : s + 4 * capacity])
            lengths = pa.array([len(p) // 4 for p in pieces], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), lengths, pa.array(totals, pa.int64()), pa.array(pieces, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return map_slices(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, doc_tokens long, ids binary", 512, 8)


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(how often, ((length, pieces of it), ...)) of each pattern.

    Lengths are placed longest first, each into the pattern that is shortest so far: the one
    with most room. Where it is used more often than there are pieces left, it is split. Where
    it has no room, new sequences begin, each with as many pieces of the length as fit. A
    pattern that can take several pieces of a length takes one at a time, so they spread evenly.
    """
    open_: dict[int, list[tuple[int, tuple]]] = {}  # room -> patterns
    done: list[tuple[int, tuple]] = []
    rooms: list[int] = []  # a heap of -room

    def put(count: int, places: tuple, room: int) -> None:
        if not count:
            return
        if not room:
            done.append((count, places))
            return
        if room not in open_:
            open_[room] = []
            heapq.heappush(rooms, -room)
        open_[room].append((count, places))

    for length in sorted(histogram, reverse=True):
        left, each = histogram[length], capacity // length
        while left:
            while rooms and not open_.get(-rooms[0]):
                open_.pop(-heapq.heappop(rooms), None)
            room = -rooms[0] if rooms else 0
            if room < length:
                put(left // each, ((length, each),), capacity - each * length)
                put(min(1, left % each), ((length, left % each),), capacity - left % each * length)
                break
            count, places = open_[room].pop()
            used = min(left, count)
            put(count - used, places, room)
            same = places[-1][0] == length
            put(used, (*places[:-1], (length, places[-1][1] + 1)) if same else (*places, (length, 1)), room - length)
            left -= used
    return done + [x for entries in open_.values() for x in entries]


def placements(patterns: list[tuple[int, tuple]], capacity: int, least_fill: float = LEAST_FILL) -> list[tuple]:
    """(length, first rank, last rank, pieces in each sequence, first sequence_id, offset, stream, padded length) of each place.

    Of the pieces of a length, the ranks from first to last fill this place in the pattern's
    uses in turn. The pieces of patterns that are filled less than `least_fill` go into one
    stream instead, end to end, that is cut every `capacity` tokens: `stream` is where the
    first of them begins there, -1 for the others. A sequence is padded to `capacity`, but not
    where its length is a power of two.
    """
    rows, ranks, base = [], {}, 0
    full, loose = [], {}
    for count, places in patterns:
        if sum(n * k for n, k in places) >= least_fill * capacity:
            full.append((count, places))
        else:
            for length, k in places:
                loose[length] = loose.get(length, 0) + k * count
    for count, places in sorted(full, key=lambda p: p[1], reverse=True):
        total, offset = sum(n * k for n, k in places), 0
        padded = total if total & (total - 1) == 0 else capacity
        for length, k in places:
            first = ranks.get(length, 0)
            rows.append((length, first, first + count * k - 1, k, base, offset, -1, padded))
            ranks[length] = first + count * k
            offset += length * k
        base += count
    at, end = 0, sum(n * count for n, count in loose.items())
    rest = end % capacity
    for length in sorted(loose, reverse=True):
        first = ranks.get(length, 0)
        rows.append((length, first, first + loose[length] - 1, 0, base, 0, at, rest if rest & (rest - 1) == 0 else capacity))
        at += length * loose[length]
    return rows


def pack(pieces: DataFrame, capacity: int = 4096, least_fill: float = LEAST_FILL) -> DataFrame:
    """Rows of `pieces` with sequence_id, offset, cut_from, cut_length and padded_length.

    `pieces` has a column length from 1 to `capacity`; its other columns are kept, and equal
    rows are packed each for itself. A piece goes whole (cut_from 0, cut_length its length) or,
    where the stream is cut, in two parts. It is read twice, so pass a table, not a long plan.
    An empty table gives an empty one. The plan's rows, which are broadcast, are as many as the
    places of the patterns, a number that `capacity` bounds.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows = placements(plan_patterns(histogram, capacity), capacity, least_fill)
    plan = spark.createDataFrame(rows, "_length long, _first long, _last long, _each long, _base long, _offset long, _stream long, _padded long")
    buckets = max(LEAST_BUCKETS, -(-sum(histogram.values()) // PER_BUCKET))
    placed = ranked(pieces, ["length"], buckets, "_rank").join(F.broadcast(plan), (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last")))
    nth = F.col("_rank") - F.col("_first")
    begin = F.col("_stream") + nth * F.col("length")
    head = F.least(F.col("length"), F.lit(capacity) - F.pmod(begin, F.lit(capacity)))
    ends = sum(n * (last - first + 1) for n, first, last, _, _, _, stream, _ in rows if stream >= 0)
    last_one = F.floor(F.lit(max(0, ends - 1)) / capacity)

    def part(start, length):
        number = F.floor((begin + start) / capacity)
        padded = F.when((number == last_one) & (F.lit(ends % capacity) > 0), F.col("_padded")).otherwise(F.lit(capacity)).cast("long")
        return F.struct((F.col("_base") + number).alias("sequence_id"), F.pmod(begin + start, F.lit(capacity)).cast("long").alias("offset"), start.cast("long").alias("cut_from"), length.cast("long").alias("cut_length"), padded.alias("padded_length"))

    each = F.greatest(F.col("_each"), F.lit(1))
    whole = F.struct((F.col("_base") + F.floor(nth / each)).alias("sequence_id"), (F.col("_offset") + F.pmod(nth, each) * F.col("length")).cast("long").alias("offset"), F.lit(0).cast("long").alias("cut_from"), F.col("length").cast("long").alias("cut_length"), F.col("_padded").alias("padded_length"))
    parts = F.when(F.col("_stream") < 0, F.array(whole)).when(head < F.col("length"), F.array(part(F.lit(0), head), part(head, F.col("length") - head))).otherwise(F.array(part(F.lit(0), F.col("length"))))
    return placed.select(*pieces.columns, F.inline(parts))


def packed_documents(docs: DataFrame, capacity: int = 4096, least_fill: float = LEAST_FILL) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length): the pieces of `docs` and their places.

    Null and empty texts are the end id alone; null ids and repeated rows are documents like
    others; an empty table gives an empty one; other columns are not read. Texts of any length
    are cut into pieces of `capacity` ids and a rest. The ids of pieces that the stream cuts are
    read once more, for the parts' checksums.
    """
    made = stage(tokenized_pieces(docs, capacity).withColumn("ids_crc32", F.crc32("ids")).withColumn("_key", F.xxhash64("ids")))
    placed = stage(pack(made.drop("ids"), capacity, least_fill))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]
    whole = placed.where("cut_length = length").select(*names)
    cut = placed.where("cut_length < length")
    keys = ["start", "length", "ids_crc32", "_key"]
    # at most `capacity` lengths; the ids of others are not shuffled
    lengths = [r["length"] for r in cut.select("length").distinct().collect()]
    ids = made.where(F.col("length").isin(lengths)).join(cut.select(*keys).distinct(), keys, "left_semi").select(*keys, "ids").dropDuplicates(keys)
    parts = cut.join(ids, keys).select("doc_id", (F.col("start") + F.col("cut_from")).alias("start"), F.col("cut_length").alias("length"), F.crc32(F.expr("substring(ids, cast(4 * cut_from + 1 as int), cast(4 * cut_length as int))")).alias("ids_crc32"), *names[4:])
    return whole.unionByName(parts)
