r"""Suffix-array dedup by a depth-limited radix sort.

A text is a row of tokens: its bytes (BYTES), or its words (`[^\x20\x09-\x0D]+`, WORDS: white space between words is all the same then). All suffixes are
ordered through `window` tokens and no further; suffixes that still share a group then are exactly the repeated windows, and what they cover, from the first
token to the last, goes. The passes, most significant digit first, drop what has become alone:

1. The first digit of a suffix is the rarest-looking gram of its window: of the strings of `gram` tokens in it the one with the smallest fingerprint, leftmost
   on ties, and its place in the window. Equal windows have equal first digits, and neighbouring suffixes nearly always share one, so a document is a short
   list of runs of suffixes, one run to a gram (of bytes, about one in 169). A partial aggregate counts the grams; runs of grams that occur once are done.
2. The runs that are left travel with the bytes they span. Equal runs are counted by a partial aggregate (copies of a document or a passage, however many,
   shrink to one row per task) and are repeated as wholes.
3. Different runs of one gram meet in one task, ordered by gram; there the next digits (the halves of the windows, as 64-bit fingerprints each) divide the
   groups further. What is left in a group is held against the group's first window byte by byte, a stretch of neighbouring windows at a time; where they
   differ, as fingerprints of chosen texts may, the group is divided by the bytes themselves. So no removal rests on a fingerprint.

A gram whose different runs take over `most_bytes` together isn't sent to one task: its runs are cut into shorter ones, whose digit is all that their
windows have in common, and go through steps 2 and 3 again; runs of one window are settled by counting alone. So no group is unbounded.

Null text counts as empty. A null doc_id is kept as such. Rows that repeat a doc_id and text are copies of each other; they travel as one row that counts as
many. Texts under a window lose nothing. An empty table gives no rows. Other columns stay as they are, whatever their names. Removals are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, forget, parts, pick, text_name, trimmed, written
from .fingerprints import prefix_sums, prints
from .units import slices

#: Kinds of tokens, and for each the tokens of a window and of a gram.
BYTES, WORDS = "bytes", "words"
WINDOW, GRAM = 400, 64
WORD_WINDOW, WORD_GRAM = 50, 8
#: Windows of a long text looked at together, and bytes of different runs of one gram that a task may get.
SPAN, MOST_BYTES = 1 << 20, 32 << 20
#: The runs of a crowded gram are cut to this part of a window, and if need be to single windows.
CUT = 12
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _tokens(text: bytes, kind: str) -> bytes:
    """The tokens side by side; a word is followed by one space."""
    return text if kind == BYTES else b"".join(w + b" " for w in text.split())


def _bounds(data: np.ndarray, kind: str) -> np.ndarray:
    """Where each token begins, and the end."""
    return np.arange(len(data) + 1) if kind == BYTES else np.concatenate([[0], np.flatnonzero(data == 32) + 1])


def places(text: bytes, ranges: list[tuple[int, int]], kind: str) -> list[tuple[int, int]]:
    """Ranges of tokens as ranges of a text's bytes."""
    if kind == BYTES or not ranges:
        return ranges
    edge = np.flatnonzero(np.diff(np.concatenate([[1], _SPACE[np.frombuffer(text, np.uint8)].view(np.int8), [1]])))
    return [(int(edge[2 * a]), int(edge[2 * b - 1])) for a, b in ranges]


def _sliding(values: np.ndarray, width: int, pick_) -> np.ndarray:
    """pick_ (np.minimum or np.maximum) over each `width` neighbours; one row to a place where they all exist."""
    n = len(values)
    blocks = -(-n // width)
    fill = np.uint64(0xFFFFFFFFFFFFFFFF) if pick_ is np.minimum else np.uint64(0)
    padded = np.full(blocks * width, fill, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = pick_.accumulate(grid, axis=1).ravel()
    behind = pick_.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick_(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram's fingerprint, its place, first window, last window) of the runs of windows that share their smallest gram, in tokens. `data` holds several
    texts, from starts to ends (in tokens); windows lie within one text each."""
    none = np.zeros(0, np.int64)
    tokens = len(bounds) - 1
    if tokens < window:
        return none.astype(np.uint64), none, none, none
    width = window - gram + 1
    marks = prints(prefix_sums(data), bounds[: tokens - gram + 1], bounds[gram:] - bounds[: tokens - gram + 1])
    least = _sliding(marks, width, np.minimum)  # of each window
    step = np.zeros(tokens + 1, np.int8)
    whole = ends - starts >= window
    step[starts[whole]] += 1
    step[ends[whole] - window + 1] -= 1
    valid = np.cumsum(step[: len(least)]).astype(bool)
    least[~valid] = 0
    edge = np.zeros(width - 1, np.uint64)
    chosen = _sliding(np.concatenate([edge, least, edge]), width, np.maximum) == marks  # is the smallest of some window it is in
    where = np.flatnonzero(chosen)
    values, rank = np.unique(marks[where], return_inverse=True)
    size = np.int64(tokens + 1)
    keys = np.sort(rank * size + where)
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(least)]]) - 1
    first, last = first[valid[first]], last[valid[first]]
    if not len(first):
        return none.astype(np.uint64), none, none, none
    kind = np.searchsorted(values, least[first])
    a = np.searchsorted(keys, kind * size + first)
    b = np.searchsorted(keys, kind * size + last + width - 1, side="right")
    many = b - a
    run = np.repeat(np.arange(len(first)), many)
    place = keys[np.repeat(a - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())] - kind[run] * size
    head = np.concatenate([[True], run[1:] != run[:-1]])
    lo = np.where(head, first[run], np.concatenate([[0], place[:-1] + 1]))
    hi = np.minimum(place, last[run])
    ok = lo <= hi
    return values[kind[run[ok]]], place[ok], lo[ok], hi[ok]


def _chunks(texts: list[bytes | None], window: int, kind: str):
    """Texts side by side, about SPAN bytes at a time: (data, bounds, starts, ends, rows, offsets), the last four in tokens or of texts. A longer text comes
    in pieces that hold each window once."""
    held, size = [], 0
    step = SPAN if kind == BYTES else SPAN // 8

    def joined():
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        bounds, beyond = _bounds(data, kind), np.cumsum([len(x) for _, _, x in held])
        ends = np.searchsorted(bounds, beyond)
        starts = np.concatenate([[0], ends[:-1]])
        rows, offsets = (np.array([x[i] for x in held]) for i in (0, 1))
        return data, bounds, starts, ends, rows, offsets

    for row, text in enumerate(texts):
        if len(text or b"") < window:
            continue
        tokens = _tokens(text, kind)
        pieces = [(0, tokens)]
        if len(tokens) > SPAN:
            bounds = _bounds(np.frombuffer(tokens, np.uint8), kind)
            last = len(bounds) - 1
            pieces = [(at, tokens[bounds[at] : bounds[min(last, at + step + window - 1)]]) for at in range(0, last - window + 1, step)]
        for at, piece in pieces:
            held.append((row, at, piece))
            size += len(piece)
            if size >= SPAN:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _grams(batches, window: int, gram: int, kind: str):
    """(dk, th, gram, n): the grams that stand for a text's windows, and at how many places."""
    for batch in batches:
        for data, bounds, starts, ends, rows, _ in _chunks(batch.column(2).to_pylist(), window, kind):
            found, place, _, _ = runs_of(data, bounds, starts, ends, window, gram)
            row = rows[np.searchsorted(starts, place, side="right") - 1]
            order = np.lexsort((found, row))
            found, row = found[order], row[order]
            head = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (row[1:] != row[:-1])])) if len(found) else np.zeros(0, int)
            at = pa.array(row[head])
            n = np.diff(np.append(head, len(found))) * batch.column(3).to_numpy()[row[head]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found[head].view(np.int64)), pa.array(n.astype(np.int64))], names=["dk", "th", "gram", "n"])


RUNS = "dk long, th binary, gram long, rel int, n long, firsts array<long>, id binary, span binary"


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _spans(batches, window: int, gram: int, kind: str):
    """The runs of the grams listed with each text, with their bytes; equal runs of a text are one row with all their places. A text that stands for many
    copies counts as many."""
    names = [x.split()[0] for x in RUNS.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    both = lambda grams, rows: grams * np.uint64(0x9E3779B97F4A7C15) + rows.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for batch in batches:
        for first, beyond in slices(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist(), 4 * SPAN):
            part = batch.slice(first, beyond - first)
            dk, th, texts = (part.column(i).to_pylist() for i in range(3))
            lists, copies = part.column(3), part.column(4).to_pylist()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            wanted = both(lists.flatten().to_numpy().astype(np.int64).view(np.uint64), np.repeat(np.arange(len(texts)), sizes))
            mine: dict[tuple, list[int]] = {}
            for data, bounds, starts, ends, rows, offsets in _chunks(texts, window, kind):
                found, place, lo, hi = runs_of(data, bounds, starts, ends, window, gram)
                piece = np.searchsorted(starts, place, side="right") - 1
                few = np.flatnonzero(np.isin(both(found, rows[piece]), wanted))
                whole = data.tobytes()
                shift = offsets[piece] - starts[piece]
                for row, g, rel, a, x, y, s in zip(*(v[few].tolist() for v in (rows[piece], found.view(np.int64), lo - place, lo, bounds[lo], bounds[hi + window], shift)), strict=True):
                    mine.setdefault((row, g, rel, whole[x:y]), []).append(a + s)
            out, held = [], 0
            for (row, g, rel, span), firsts in mine.items():
                out.append((dk[row], th[row], g, rel, len(firsts) * copies[row], firsts, _id(g, rel, span), span))
                held += len(span)
                if held > 4_000_000:
                    yield _batch(out, names, kinds)
                    out, held = [], 0
            if out:
                yield _batch(out, names, kinds)


def _id(gram: int, rel: int, span: bytes) -> bytes:
    return hashlib.blake2b(span, digest_size=16, key=b"%d %d" % (gram, rel)).digest()


def _confirmed(data: np.ndarray, bounds: np.ndarray, run: np.ndarray, at: np.ndarray, lead: np.ndarray, name: np.ndarray, window: int) -> np.ndarray:
    """Names that equal windows share, of groups whose windows have equal fingerprints: `lead` is the first window of each one's group. Windows come in order
    of (run, at)."""
    whole = data.tobytes()
    delta = lead - at
    cuts = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1) | (delta[1:] != delta[:-1]), [True]]))
    wrong = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        if delta[a] and whole[bounds[at[a]] : bounds[at[b - 1] + window]] != whole[bounds[lead[a]] : bounds[lead[b - 1] + window]]:
            wrong.append(name[a:b])
    if wrong:
        bad = np.flatnonzero(np.isin(name, np.concatenate(wrong)))
        own: dict[tuple, int] = {}
        fresh = int(name.max()) + 1
        name = name.copy()
        for i in bad.tolist():
            name[i] = own.setdefault((int(name[i]), whole[bounds[at[i]] : bounds[at[i] + window]]), fresh + len(own))
    return name


def _divided(grams: np.ndarray, rels: np.ndarray, counts: np.ndarray, spans: list[bytes], window: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Of runs: which windows are repeated, as (run, window) pairs in order."""
    data = np.frombuffer(b"".join(spans), np.uint8)
    bounds = _bounds(data, kind)
    ends = np.searchsorted(bounds, np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans))))
    starts = np.concatenate([[0], ends[:-1]])
    windows = ends - starts - window + 1
    run = np.repeat(np.arange(len(spans)), windows)
    inner = np.arange(windows.sum()) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    sums = prefix_sums(data)
    at = starts[run] + inner
    group = np.unique(grams, return_inverse=True)[1][run] * np.int64(2 * window) + (rels[run] + inner)
    half = window // 2
    live = np.arange(len(run))
    for start, size in ((0, half), (half, window - half)):
        x = bounds[at[live] + start]
        digit = prints(sums, x, bounds[at[live] + start + size] - x)
        order = np.lexsort((digit, group))
        g, d = group[order], digit[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if len(g) else np.zeros(0, bool)
        name = np.cumsum(new) - 1
        held = np.bincount(name, weights=counts[run[live[order]]], minlength=0)
        keep = held[name] > 1
        live, group = live[order][keep], name[keep]
    if not len(live):
        return live, live
    first = np.full(int(group.max()) + 1, -1, np.int64)
    first[group[::-1]] = at[live[::-1]]
    order = np.argsort(live)
    live, group = live[order], group[order]
    name = _confirmed(data, bounds, run[live], at[live], first[group], group, window)
    live = live[np.bincount(name, weights=counts[run[live]])[name] > 1]
    return run[live], inner[live]


def _decide(batches, window: int, kind: str):
    """Rows come ordered by gram; a gram's rows are held until all of them are there."""
    held: list[pa.RecordBatch] = []
    size = 0

    def work(table: pa.Table):
        grams, rels, counts = (table[c].to_numpy() for c in ("gram", "rel", "n"))
        spans = table["span"].to_pylist()
        run, inner = _divided(grams, rels.astype(np.int64), counts, spans, window, kind)
        if not len(run):
            return None
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (inner[1:] != inner[:-1] + 1)])
        a = np.flatnonzero(new)
        b = np.concatenate([a[1:], [len(run)]]) - 1
        return pa.RecordBatch.from_arrays([table["id"].combine_chunks().take(pa.array(run[a])), pa.array(inner[a].astype(np.int32)), pa.array(inner[b].astype(np.int32))], names=["id", "first", "last"])

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < 4_000_000:
            continue
        table = pa.Table.from_batches(held)
        grams = table["gram"].to_numpy()
        cut = int(np.searchsorted(grams, grams[-1])) if len(grams) else 0
        if cut:
            if (out := work(table.slice(0, cut))) is not None:
                yield out
            held = table.slice(cut).to_batches()
            size = sum(b.nbytes for b in held) if len(held) > 1 else 0
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows and (out := work(table)) is not None:
            yield out


def _cut(batches, window: int, size: int, kind: str):
    """Cuts runs into runs of at most `size` windows, on one grid of places relative to the gram. The new gram is the fingerprint of the tokens that all
    windows of a grid cell share; every piece holds them."""
    names = ["whole", "skip", "gram", "rel", "n", "id", "span"]
    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        for row in batch.to_pylist():
            span, rel, at, out = row["span"], row["rel"], 0, []
            bounds = _bounds(np.frombuffer(span, np.uint8), kind)
            windows = len(bounds) - window
            while at < windows:
                cell = (rel + at) // size
                end = min(windows, (cell + 1) * size - rel)
                piece = span[bounds[at] : bounds[end - 1 + window]]
                core = span[bounds[(cell + 1) * size - 1 - rel] : bounds[cell * size - rel + window]]
                gram = int.from_bytes(_id(row["gram"], cell, core)[:8], "little", signed=True)
                out.append((row["id"], at, gram, rel + at, row["n"], _id(gram, rel + at, piece), piece))
                at = end
            yield _batch(out, names, kinds)


def _different(runs: DataFrame) -> DataFrame:
    return runs.groupBy("gram", "rel", "id", "span").agg(F.sum("n").alias("n")).withColumn("size", F.octet_length("span"))


def _repeats(runs: DataFrame, window: int, most_bytes: int, cuts: tuple[int, ...], kind: str) -> DataFrame:
    """(id, first, last): the repeated windows of the runs, as stretches of windows counted from a run's first."""
    runs = written(_different(runs), "suffix-different")
    if not cuts:  # runs of one window
        return runs.filter("n > 1").select("id", F.lit(0).alias("first"), F.lit(0).alias("last"))
    crowded = written(runs.groupBy("gram").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > most_bytes).select("gram"), "suffix-crowded")
    some = not crowded.isEmpty()
    near = runs.join(crowded, "gram", "left_anti") if some else runs
    ordered = near.select("gram", "rel", "id", "span", "n").repartition(parts(runs.sparkSession), "gram").sortWithinPartitions("gram")
    found = ordered.mapInArrow(lambda b: trimmed(_decide(b, window, kind)), "id binary, first int, last int")
    if some:
        cut = written(
            runs.join(crowded, "gram", "left_semi").select("gram", "rel", "id", "span", "n").mapInArrow(lambda b: trimmed(_cut(b, window, cuts[0], kind)), "whole binary, skip int, gram long, rel int, n long, id binary, span binary"),
            "suffix-cut",
        )
        inner = _repeats(cut, window, most_bytes, cuts[1:], kind).join(cut.select("id", "whole", "skip"), "id")
        found = found.unionAll(inner.select(F.col("whole").alias("id"), (F.col("skip") + F.col("first")).alias("first"), (F.col("skip") + F.col("last")).alias("last")))
    return found


def _name(docs: DataFrame) -> Callable[[Column], Column]:
    """What tells rows of one doc_id apart, from their text: nothing where no two rows share a doc_id, which spares the names."""
    ids = pick(docs, doc_id="long").groupBy(F.coalesce("doc_id", F.lit(NO_ID))).agg(F.count("*").alias("n"))
    return (lambda text: F.lit(bytearray())) if ids.filter("n > 1").isEmpty() else text_name


def _base(docs: DataFrame, name: Callable[[Column], Column]) -> DataFrame:
    """(dk, th, bytes, copies): rows equal in doc_id and text as one. Only a table that has such rows pays for their aggregate; its partial step leaves
    one row of a large group to each task."""
    rows = pick(docs, doc_id="long", text="string").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("dk"), name(F.col("text")).alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    if name is not text_name or rows.groupBy("dk", "th").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return rows.withColumn("copies", F.lit(1).cast("long"))
    return rows.groupBy("dk", "th").agg(F.first("bytes").alias("bytes"), F.count("*").alias("copies"))


def repeated_ranges(docs: DataFrame, name: Callable[[Column], Column], kind: str = BYTES, window: int | None = None, gram: int | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(dk, th, ranges): of texts with repeated windows, the tokens these cover as (start, end) pairs that may overlap. dk and th are doc_id
    (null: the largest long) and what `name` makes of the text."""
    window = window or (WINDOW if kind == BYTES else WORD_WINDOW)
    gram = gram or (GRAM if kind == BYTES else WORD_GRAM)
    base = _base(docs, name)
    grams = written(base.mapInArrow(lambda b: trimmed(_grams(b, window, gram, kind)), "dk long, th binary, gram long, n long"), "suffix-grams")
    often = grams.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram")
    wanted = grams.join(often, "gram", "left_semi").groupBy("dk", "th").agg(F.collect_set("gram").alias("grams"))
    texts = base.join(wanted, ["dk", "th"]).select("dk", "th", "bytes", "grams", "copies")
    runs = written(texts.mapInArrow(lambda b: trimmed(_spans(b, window, gram, kind)), RUNS), "suffix-runs")
    forget(grams)
    found = _repeats(runs.select("gram", "rel", "id", "span", "n"), window, most_bytes, (max(2, window // CUT), 1), kind)
    spots = found.join(runs.select("id", "dk", "th", "firsts"), "id").select("dk", "th", "first", "last", F.explode("firsts").alias("at"))
    return spots.groupBy("dk", "th").agg(F.collect_list(F.struct((F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("last") + window).alias("end"))).alias("ranges"))


def merged(ranges) -> list[tuple[int, int]]:
    """Maximal runs of tokens; ranges that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: What deduplicated() puts behind the columns of its input.
ADDED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """All columns of `docs` and, as the last five, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes) and kept_text:
    the remaining bytes as text, less those that are left of a character of which others went."""
    cols = docs.columns
    kind = how.get("kind", BYTES)
    name = _name(docs)
    ranges = repeated_ranges(docs, name, **how)
    plain = docs.toDF(*(f"_{i}" for i in range(len(cols))))
    kinds = [t for _, t in docs.dtypes]
    at = cols.index("text")
    text = F.col(f"_{at}").cast("string")
    keyed = plain.select("*", F.coalesce(F.col(f"_{cols.index('doc_id')}").cast("long"), F.lit(NO_ID)).alias("dk"), name(text).alias("th"))
    joined = keyed.join(ranges, ["dk", "th"], "left").select(*plain.columns, "ranges", *([] if kinds[at] == "string" else [text.alias("body")]))
    body = at if kinds[at] == "string" else len(cols) + 1

    def run(batches):
        names = [*(f"_{i}" for i in range(len(cols))), *(x.split()[0] for x in ADDED.split(", "))]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for a, b in slices(pc.fill_null(pc.binary_length(batch.column(body)), 0).to_pylist(), 8 * SPAN):
                part = batch.slice(a, b - a)
                rows = []
                for whole, found in zip(part.column(body).cast(pa.binary()).to_pylist(), part.column(len(cols)).to_pylist(), strict=True):
                    whole = whole or b""
                    gone, left, upto = places(whole, merged(found), kind), [], 0
                    for start, end in gone:
                        left.append(whole[upto:start])
                        upto = end
                    rest = b"".join([*left, whole[upto:]]) if gone else whole
                    rows.append((len(whole), len(whole) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(cols)], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    out = joined.mapInArrow(lambda b: trimmed(run(b)), ", ".join(f"_{i} {t}" for i, t in enumerate(kinds)) + f", {ADDED}")
    return out.toDF(*cols, *(x.split()[0] for x in ADDED.split(", ")))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns and, as `text`, what is left of each text."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string")
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))


#: Windows are compared by their md5 here. `text` is what is left less the bytes that are part of no character, found in hexadecimal.
OP7_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(array_slice(b, i + 1, i + {WINDOW})) AS s FROM (SELECT r, b, unnest(range(octet_length(b) - {WINDOW} + 1)) AS i FROM d)),
often AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + {WINDOW}, -1) AS new FROM w SEMI JOIN often USING (s)),
span AS (SELECT r, k, min(i) AS a, max(i) + {WINDOW} AS e FROM (SELECT r, i, sum(new::int) OVER (PARTITION BY r ORDER BY i) AS k FROM hit) GROUP BY r, k),
edge AS (SELECT r, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY a) AS a, a AS e FROM span UNION ALL SELECT r, max(e), 1::bigint << 40 FROM span GROUP BY r),
rest AS (SELECT r, string_agg(hex(array_slice(b, a + 1, e)), '' ORDER BY a) AS h FROM edge JOIN d USING (r) GROUP BY r),
n AS (SELECT r, sum(e - a)::bigint AS n_removed, count(*) AS n_spans FROM span GROUP BY r),
o AS (SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(unhex(h), b) AS kept, coalesce(h, '') AS h
      FROM d LEFT JOIN n USING (r) LEFT JOIN rest USING (r))
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(kept) AS kept_sha256,
       coalesce(try(decode(kept)), decode(unhex(array_to_string([x FOR x IN regexp_extract_all(h,
         '[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|E[1-9ABCEF](?:[89AB].){{2}}|ED[89].[89AB].|F0[9AB].(?:[89AB].){{2}}|F[123](?:[89AB].){{3}}|F48.(?:[89AB].){{2}}|..')
         IF length(x) > 2 OR x < '80'], '')))) AS text
FROM o
"""
