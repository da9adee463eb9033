"""Best-fit packing planned on a histogram of lengths.

Documents are tokenised once into pieces of at most `capacity` ids; the pieces' places and lengths (no ids) are written to the shared
folder. Only the histogram of lengths, at most `capacity` counts, goes to the driver, where best fit decreasing runs over counts: a range
of equal sequences takes all it can of a length at a time, so the work depends on the number of different lengths and not of documents.
Each piece then finds its slot by its rank within its length. Ranks are dealt out over chunks of a length (a hash of the piece, so a length
that a third of all pieces have is ranked by many tasks); the chunks' starts are at most capacity + 4 * tasks numbers and are broadcast.

Null text counts as empty: one piece with the end id alone. A null doc_id is kept as such. Repeated rows are packed each. Ties in rank are
rows equal in all columns. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, pick, trimmed, written
from .units import slices

CAPACITY, END_ID = 1024, 2
VOCABULARY = "byte_bpe_50k.json"
#: The pattern by which byte-level BPE vocabularies cut texts. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: tiktoken's engine keeps a state for each character of white space and breaks at a run of a million; runs from this length on are cut out before it.
LONG = 100_000
#: What PATTERN means by white space (Unicode's White_Space; Python's own class has more).
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUN = re.compile(f"(?<!{_SPACE}){_SPACE}{{{LONG},}}")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies spell bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Encoder:
    """Ids of whole texts as the tokenizers library gives them.

    A byte-level BPE vocabulary whose merges come in the order of the ids they make is the same as a table of ranks; texts are then encoded by ranks, a
    faster way to the same ids. All else goes through the tokenizers library: any other vocabulary, and texts that spell a special token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_rank = None
        if ranks := self._ranks(path):
            import tiktoken

            self.by_rank = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _ranks(path: str) -> dict[bytes, int] | None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, first = told["model"], told.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or told.get("normalizer") or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True):
            return None
        letters, special = _byte_letters(), {t["content"] for t in told["added_tokens"]}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(made) or model.get("dropout") or any(made[0] < model["vocab"].get(c, made[0]) for c in letters):
            return None
        return {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}

    def _by_rank(self, text: str):
        """Ids of a text's parts. PATTERN makes one unit of a run of white space up to its last character, which goes with what follows (or with the
        run, at the text's end); so a long run is encoded as the unit it is, and the texts about it give the ids they give in place."""
        at = 0
        for run in _RUN.finditer(text) if len(text) >= LONG else ():
            end = run.end() - (run.end() < len(text))
            yield self.by_rank.encode_ordinary(text[at : run.start()])
            yield self.by_rank._encode_single_piece(text[run.start() : end])
            at = end
        yield self.by_rank.encode_ordinary(text[at:])

    def of(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.by_rank and not any(s in text for s in self.special):
            return b"".join(np.array(ids, "<u4").tobytes() for ids in self._by_rank(text))
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    """One to a worker, which keeps it from task to task."""
    return Encoder(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text's ids and the end id; of a text that is cut, the first piece is the short one."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for a, b in slices(sizes):
                rows = []
                for key, text in zip(keys[a:b], texts.slice(a, b - a).to_pylist(), strict=True):
                    ids = coder.of(text or "") + end
                    n, at, k = len(ids) // 4, 0, 0
                    while at < n:
                        size = (n % capacity or capacity) if at == 0 else capacity
                        rows.append((key, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                        at, k = at + size, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return pick(docs, doc_id="long", text="string").mapInArrow(lambda b: trimmed(run(b)), PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over counts: rows (length, first rank, first sequence, offset, pieces a sequence). The piece of rank r goes to
    sequence first + (r - first rank) // k at offset + (r - first rank) % k * length."""
    room: dict[int, list[tuple[int, int]]] = {}  # free ids: ranges of sequences (first, how many)
    free: list[int] = []  # sorted keys of room
    out, fresh = [], 0

    def put(left: int, first: int, many: int) -> None:
        if left and many:
            if left not in room:
                bisect.insort(free, left)
                room[left] = []
            room[left].append((first, many))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            i = bisect.bisect_left(free, length)
            if i < len(free):
                left = free[i]
                first, many = room[left].pop()
                if not room[left]:
                    del room[left], free[i]
            else:
                left, first, many = capacity, fresh, -(-todo // (capacity // length))
                fresh += many
            each = left // length
            full = min(many, todo // each)
            if full:
                out.append((length, rank, first, capacity - left, each))
                put(left - each * length, first, full)
                todo, rank = todo - full * each, rank + full * each
            rest, first = many - full, first + full
            if rest and todo and todo < each:
                out.append((length, rank, first, capacity - left, todo))
                put(left - todo * length, first, 1)
                todo, rest, first = 0, rest - 1, first + 1
            put(left, first, rest)
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = docs.sparkSession
    rows = written(pieces(docs, path, capacity, end_id), "pack-pieces")
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    share = max(1, -(-sum(histogram.values()) // (4 * parts(spark))))
    spread = spark.createDataFrame([(k, -(-n // share)) for k, n in histogram.items()], "length int, chunks int")
    dealt = rows.join(F.broadcast(spread), "length").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "chunks").cast("int")).drop("chunks")
    sizes = sorted((r.length, r.chunk, r.n) for r in dealt.groupBy("length", "chunk").agg(F.count("*").alias("n")).collect())  # at most capacity + 4 * tasks
    starts, before = [], (None, 0)
    for length, chunk, n in sizes:
        base = before[1] if before[0] == length else 0
        starts.append((length, chunk, base))
        before = (length, base + n)
    order = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("rn", F.row_number().over(order))
        .join(F.broadcast(spark.createDataFrame(starts, "length int, chunk int, base long")), ["length", "chunk"])
        .select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("base") + F.col("rn") - 1).alias("rank"))
    )
    steps = np.array(sorted(plan(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    wide = np.int64(1) << np.int64(48)  # more ranks than this would need more pieces than any table has

    def run(batches):
        keys = steps[:, 0] * wide + steps[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            s = steps[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            i = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(s[:, 2] + i // s[:, 4]), pa.array(s[:, 3] + i % s[:, 4] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(VOCABULARY))
