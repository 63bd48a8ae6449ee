"""Best-fit packing of tokenised documents, planned on the histogram of lengths."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abridge.llm.common import Scratch, text_of

CAPACITY = 1024
END_ID = 2
RANK_ROWS = 2_000  # pieces of one length that are ranked together

# How the byte-level tokenizer parts a text before it merges (fixed value).
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# tiktoken's engine keeps a place to return to for each character of a run of white space and fails at 1,000,000.
# Longer runs than this are parted here; the class is that of its \s, which is not Python's.
LONG_RUN = 1 << 16
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, those of the file's ``Tokenizer.encode(text, add_special_tokens=False)``.

    The vocabulary is the tokenizer file's; it is merged by tiktoken, which gives the same ids several times faster.
    With ``added`` the strings of added tokens give these tokens' ids; without, they are ordinary text, as with the
    tokenizer's ``encode_special_tokens``.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken
        from tokenizers import Tokenizer
        # A byte-level vocabulary writes bytes that do not print as the characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain}
        letters |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        tokenizer = Tokenizer.from_file(path)
        tokens = tokenizer.get_added_tokens_decoder()
        special = {t.content for t in tokens.values()}
        ranks = {bytes(map(letters.__getitem__, token)): i for token, i in tokenizer.get_vocab().items() if token not in special}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in tokens.items()} if added else {}
        # Added tokens that take blanks with them or stand for whole words only are left to the tokenizer.
        self.tokenizer = tokenizer if any(t.lstrip or t.rstrip or t.single_word for t in tokens.values()) else None
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None

    def encode(self, text: str) -> bytes:
        if self.cut is None:
            return self._plain(text)
        if self.tokenizer is not None and self.cut.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = self.cut.split(text)  # the file's tokenizer takes added tokens out before it parts a text
        return b"".join(self.added[x] if i % 2 else self._plain(x) for i, x in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        """A run of white space is one part but for its last character, which goes with what follows (PARTS)."""
        out, at = [], 0
        for run in BLANKS.finditer(text) if len(text) >= LONG_RUN else ():
            stop = run.end() - (run.end() < len(text))
            out.append(self._merge(text[at:run.start()]))
            out.append(np.array(self.encoding._core_bpe.encode_single_piece(text[run.start():stop].encode()), "<u4").tobytes())
            at = stop
        return b"".join([*out, self._merge(text[at:])])

    def _merge(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path, added=True)


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise and cut: (doc_id, piece, start, length, ids_crc32[, ids]).

    A document is its ids and then ``end_id``; a null text is ``end_id`` alone. Only documents longer than
    ``capacity`` are cut; every piece but the first is full.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows: list[list] = [[], [], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = enc.encode(text) + tail
                    n = len(data) // 4
                    first = (n - 1) % capacity + 1
                    cuts = [0, *range(first, n + 1, capacity)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        ids = data[4 * a:4 * b]
                        for col, v in zip(rows, (doc, i, a, b - a, zlib.crc32(ids),
                                                 np.frombuffer(ids, "<i4") if with_ids else None)):
                            col.append(v)
                types = [part.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r, t) for r, t in zip(rows[:5 + with_ids], types)], names=names)

    return docs.select(F.col(id_col), text_of(text_col)).mapInArrow(run, schema)


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, rank_from, rank_to, sequence_from, per_sequence, offset).

    The pieces of a length with ranks rank_from <= r < rank_to go, ``per_sequence`` to each, into the sequences
    from ``sequence_from`` on, beginning at ``offset``. Sequences with equal free room are handled as ranges, so
    the work depends on the number of lengths and not on the number of pieces.
    """
    free: dict[int, list[list[int]]] = {}  # room -> ranges [first sequence, count]
    runs, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def put(room: int, first: int, per: int, items: int, length: int = length) -> int:
            runs.append((length, rank, rank + items, first, per, capacity - room))
            whole, rest = divmod(items, per)
            for start, count, used in ((first, whole, per), (first + whole, int(rest > 0), rest)):
                if count and room - used * length:
                    free.setdefault(room - used * length, []).append([start, count])
            return rank + items

        while left:
            room = next((r for r in range(length, capacity) if free.get(r)), None)
            if room is None:
                per = capacity // length
                first, sequences = sequences, sequences - (-left // per)
                rank, left = put(capacity, first, per, left), 0
                continue
            per = room // length
            r = free[room].pop()
            need = -(-left // per)
            if need < r[1]:
                free[room].append([r[0] + need, r[1] - need])
                r[1] = need
            items = min(left, r[1] * per)
            rank, left = put(room, r[0], per, items), left - items
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece"),
         rank_rows: int = RANK_ROWS) -> DataFrame:
    """All columns of ``pieces`` (with ``length`` from 1 to ``capacity``) plus sequence_id and offset.

    ``pieces`` is read three times and should be a stored table. The histogram has at most ``capacity`` rows, the
    plan a few runs for each; both are bounded whatever the input, and so is the broadcast of either. Pieces
    of one length are ranked in groups of about ``rank_rows`` whose counts are then added up, so a length that
    holds most pieces is spread over many tasks. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    hist = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs = spark.createDataFrame(best_fit_plan(hist, capacity) or [(0,) * 6],
                                 "_l long, _from long, _to long, _first long, _per long, _at long")
    parts = spark.createDataFrame([(k, -(-v // rank_rows)) for k, v in hist.items()] or [(0, 1)], "_l long, _n long")
    salted = pieces.join(F.broadcast(parts), F.col("length") == F.col("_l")).drop("_l")
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_n"))).drop("_n")
    counts = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"),
                           F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    ranked = salted.withColumn("_rank", rank)
    ranked = ranked.join(counts, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).drop("_l", "_s", "_salt")
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before")
    r = F.col("_rank") - F.col("_from")
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_from"))
                         & (F.col("_rank") < F.col("_to")))
    return placed.withColumns({
        "sequence_id": F.col("_first") + F.floor(r / F.col("_per")).cast("long"),
        "offset": F.col("_at") + (r % F.col("_per")) * F.col("length"),
    }).drop("_l", "_from", "_to", "_first", "_per", "_at", "_rank")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: the pieces with their places; ``with_ids`` adds the ids of each piece.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they occur; which of two equal
    rows takes which place is open. Other columns of ``docs`` are not carried along.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.store(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids), "pieces")
    return pack(pieces, capacity)


def sequences(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids, length); at most ``capacity`` ids each."""
    g = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    return g.select("sequence_id", ids.alias("ids"), F.size(ids).alias("length"))
