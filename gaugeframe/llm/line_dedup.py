"""Line dedup by a segment-partition edit join.

Two lines are alike when their edit distance over UTF-8 bytes is at most
``TAU``. A line of ``min_bytes`` or more that is alike to a line that occurs
before it - in order of (doc_id, line number), its own document included - is a
duplicate and is removed; the input is judged, not what is left. Of shorter lines, which a few edits
would turn into others, only exact repeats are duplicates, and empty lines are none (0 judges every line by edits). Steps:

1. *Segments.* A line is cut into TAU + 1 even segments. If two lines are
   alike, some segment of the shorter occurs in the longer at a place that the
   multi-match-aware window allows. A line's own segments are index rows; the
   windows of each length within TAU are its probes. Keys name the segment's
   number, size - which bounds the line's length - and content, so that windows
   that several lengths share are one row. One cumulative sum gives the hashes.
2. *Runs.* Rows of a key meet the key's first row, its leader, twice: within a
   batch of rows of a task, where only the leader goes on by its key and the others go by
   their line, so that a key of any number of lines is a row per batch; then the
   batches' leaders are sorted and streamed. Equal lines are decided on the way.
   A key of one line vanishes.
3. *Leaders* are verified once per pair. A line found to be a duplicate needs no
   further partner, so a segment that many lines share costs a pair for each
   line instead of all pairs.
4. *The rest.* Lines still undecided meet the earlier lines of their keys, the
   first line too if the key has leaders in several batches. What is left of two
   alike lines without the segment they share is alike again, so a key of many
   lines is cut by segments of the remainders, and these again: in the shuffle
   while a key has more than ``TILE`` lines, and then within the task, which holds one
   tile of a key. Nothing is lost; what shares all of these is compared pair by pair.
5. *Verify.* A band of 2 TAU + 1 diagonals, as bits: an automaton with a word for
   each number of edits, many pairs at once; on long lines it jumps to the next
   byte at which a diagonal differs.

Ids are whole numbers. Null texts stay null and empty texts empty; rows without an id are not judged. A doc_id that repeats is read as
further lines of the same number; of such equal places the lines are all
judged, and none removes another. Texts are split whole, however long; an
empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name, release, shielded
from .tokens import chunks, hash_ranges, mix

TAU, MIN_BYTES = 2, 24
#: Bounds of a tile, in lines and bytes, and of the rows of a task that meet before they are dealt out.
TILE, TILE_BYTES, BATCH = 4096, 32 << 20, 1 << 18
#: Levels of segments below a key's own; a group of this many lines is compared pair by pair.
LEVELS, SMALL = 3, 96
#: Longer lines are verified one pair at a time.
LONG = 512
INDEX, PROBE, WHOLE, DECIDED = range(4)
#: The key of lines too short for segments, which only the parameter 0 admits.
TINY = np.uint64(0x5C0FFEE5C0FFEE55)


def segment_starts(n: np.ndarray, tau: int) -> np.ndarray:
    """Starts of the tau + 1 segments of lines of n bytes, and their ends; the last segments are one byte longer."""
    parts = tau + 1
    i = np.arange(parts + 1)
    return i * (n // parts)[:, None] + np.maximum(0, i - (parts - n % parts)[:, None])


def windows(k: int, delta: int, tau: int) -> range:
    """Shifts at which segment k of a line delta bytes shorter can occur."""
    return range(max(-k, delta - (tau - k)), min(k, delta + (tau - k)) + 1)


def window_keys(buf: np.ndarray, s: np.ndarray, e: np.ndarray, tau: int) -> tuple[np.ndarray, ...]:
    """(line, key, begin, size, whether it is the line's own segment) of the windows of lines buf[s:e], each once."""
    n = e - s
    out: list[tuple] = []
    for k in range(tau + 1):
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        shifts = [(0, 0), *[(d, x) for d in range(tau + 1) for x in windows(k, d, tau) if (d, x) != (0, 0)]]
        for delta, shift in shifts:
            cut = segment_starts(np.maximum(n - delta, 0), tau)
            begin, size = cut[:, k] + shift, cut[:, k + 1] - cut[:, k]
            ok = (begin >= 0) & (begin + size <= n) & (size > 0)
            for b, z in seen:
                ok &= (b != begin) | (z != size)
            seen.append((begin, size))
            at = np.flatnonzero(ok)
            out.append((at, begin[at], size[at], np.full(len(at), k), np.full(len(at), (delta, shift) == (0, 0))))
    who, begin, size, k, own = (np.concatenate(x) for x in zip(*out))
    label = mix((size * (tau + 1) + k + 1).astype(np.uint64))
    key = mix(hash_ranges(buf, s[who] + begin, s[who] + begin + size) ^ label)
    tiny = np.flatnonzero(n <= 2 * tau)
    if len(tiny):
        zero = np.zeros(len(tiny), np.int64)
        who, begin, size = np.r_[who, tiny], np.r_[begin, zero], np.r_[size, zero]
        key, own = np.r_[key, np.full(len(tiny), TINY)], np.r_[own, np.ones(len(tiny), bool)]
    return who, key, begin, size, own


def lines_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each line; a line break at a document's end opens an empty line of that document."""
    edge = np.flatnonzero(buf == 10)
    of_edge, own = np.searchsorted(offs[:-1], edge, side="right") - 1, np.arange(len(offs) - 1)
    s, d = np.concatenate([offs[:-1], edge + 1]), np.concatenate([own, of_edge])
    e, f = np.concatenate([edge, offs[1:]]), np.concatenate([of_edge, own])
    order = np.lexsort((s, d))
    return s[order], e[np.lexsort((e, f))], d[order]


def key_rows(docs: DataFrame, tau: int, min_bytes: int) -> DataFrame:
    """key, h (hash of the line, or its key if it has met), doc_id, place (4 line_no + kind), lead_*: for each line its windows and its whole."""

    def run(batches):
        held: list[tuple] = []
        rows = 0
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for i, j, buf, offs in chunks(b.column("text")):
                filled = np.flatnonzero(np.diff(offs) > 0)  # empty texts have no lines that count
                if not len(filled):
                    continue
                at = np.r_[offs[filled], offs[-1]]
                s, e, d = lines_of(buf, at)
                no = np.arange(len(s)) - np.searchsorted(d, d)
                d = ids[i:j][filled][d]
                keep = e - s >= min(1, min_bytes)
                s, e, d, no = s[keep], e[keep], d[keep], no[keep]
                if not len(s):
                    continue
                h = hash_ranges(buf, s, e)
                order = np.lexsort((no, d, h))
                first = np.ones(len(h), bool)
                first[order[1:]] = h[order[1:]] != h[order[:-1]]
                lead = order[np.maximum.accumulate(np.where(first[order], np.arange(len(h)), 0))]
                same = np.empty(len(h), bool)  # a row repeated in full decides nothing about itself
                same[order] = (d[order] == d[lead]) & (no[order] == no[lead])
                gone = ~first & ~same
                held.append((np.zeros(gone.sum(), np.int64), h[gone], d[gone], no[gone] * 4 + DECIDED))
                s, e, d, no, h = s[first], e[first], d[first], no[first], h[first]
                held.append(((h * np.uint64(0x9FB21C651E98DF25)).view(np.int64), h, d, no * 4 + WHOLE))
                long = np.flatnonzero(e - s >= min_bytes)
                who, key, _, _, own = window_keys(buf, s[long], e[long], tau)
                who = long[who]
                held.append((key.view(np.int64), h[who], d[who], no[who] * 4 + np.where(own, INDEX, PROBE)))
                rows += len(who)
                if rows >= BATCH:
                    yield combined(held)
                    held, rows = [], 0
        if held:
            yield combined(held)

    def combined(held):
        """Rows of a key meet their first row here, a line's index row before its probes; only that one is dealt out by its key, the others by their line."""
        key, h, doc, place = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((place, doc, key))
        key, h, doc, place = key[order], h[order], doc[order], place[order]
        open_ = place & 3 != DECIDED
        start = np.maximum.accumulate(np.where(np.r_[True, (key[1:] != key[:-1]) | ~open_[1:] | ~open_[:-1]], np.arange(len(key)), 0))
        met = open_ & (start != np.arange(len(key)))
        equal = met & (place & 3 == WHOLE)  # of a key of whole lines all are equal
        twin = equal & (doc == doc[start]) & (place == place[start])
        keep = ~twin & (~(met & (h == h[start])) | equal)
        place = np.where(equal, place | DECIDED, place)
        met &= ~equal
        # what has met needs no hash of its line any more and keeps its key there
        deal = np.where(met | (place & 3 == DECIDED), mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)).view(np.int64), key)
        none = ~met[keep]
        arrays = [pa.array(x[keep]) for x in (deal, np.where(met, key, h.view(np.int64)), doc, place)]
        arrays += [pa.array(x[start][keep], mask=none) for x in (doc, place)]
        return pa.RecordBatch.from_arrays(arrays, ["key", "h", "doc_id", "place", "lead_doc", "lead_place"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, h long, doc_id long, place long, lead_doc long, lead_place long")


MET = "key long, doc_id long, place long, lead_doc long, lead_place long, decided boolean"


def meet(rows: DataFrame) -> DataFrame:
    """Streams rows sorted by (key, doc_id, place): each with the leader of its key, the first row.

    DECIDED rows, and WHOLE rows after their leader, come out as decided lines;
    rows of the leader's own line vanish; rows that have met pass through. So
    only two rows are ever held.
    """
    names = ["key", "h", "doc_id", "place"]

    def run(batches):
        lead = None
        for b in batches:
            before = b.column("lead_place").is_valid().to_numpy(zero_copy_only=False)
            if before.any():
                x = b.filter(pa.array(before))
                yield pa.RecordBatch.from_arrays([*[x.column(c) for c in ("h", "doc_id", "place", "lead_doc", "lead_place")], pa.array(np.zeros(len(x), bool))], ["key", "doc_id", "place", "lead_doc", "lead_place", "decided"])
                b = b.filter(pa.array(~before))
            col = {c: b.column(c).to_numpy() for c in names}
            m = len(b)
            if not m:
                continue
            kind = col["place"] & 3
            new = np.ones(m, bool)
            new[1:] = (col["key"][1:] != col["key"][:-1]) | (kind[1:] == DECIDED) | (kind[:-1] == DECIDED)
            if lead is not None and lead["key"] == col["key"][0] and kind[0] != DECIDED and lead["place"] & 3 != DECIDED:
                new[0] = False
            start = np.maximum.accumulate(np.where(new, np.arange(m), -1))
            first = {c: col[c][np.maximum(start, 0)] for c in names}
            if start[0] < 0:
                for c in names:
                    first[c][start < 0] = lead[c]
            elsewhere = (col["doc_id"] != first["doc_id"]) | (col["place"] >> 2 != first["place"] >> 2)
            decided = (kind == DECIDED) | ((kind == WHOLE) & elsewhere)
            pair = (kind <= PROBE) & (col["h"] != first["h"])
            keep = decided | pair
            lead = {c: first[c][-1] for c in names}
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(col[c][keep]) for c in ("key", "doc_id", "place")], *[pa.array(first[c][keep]) for c in ("doc_id", "place")], pa.array(decided[keep])],
                ["key", "doc_id", "place", "lead_doc", "lead_place", "decided"],
            )

    return rows.mapInArrow(run, MET)


# ---- verification ----------------------------------------------------------------------------------------------


def banded(buf: np.ndarray, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, tau: int) -> np.ndarray:
    """Whether buf[a:a+la] and buf[b:b+lb] are within tau, for many pairs whose lengths are.

    After j bytes of the second line, bit d + tau of rows[e] tells that its
    beginning turns into the first j + d bytes of the first line by at most e
    edits. buf is padded by tau bytes at either end.
    """
    out = np.zeros(len(a), bool)
    full = np.uint32((1 << (2 * tau + 1)) - 1)
    live = np.arange(len(a))
    rows = [np.full(len(a), sum(1 << (d + tau) for d in range(e + 1)), np.uint32) for e in range(tau + 1)]
    j = 0
    while len(live):
        over = lb[live] == j
        if over.any() or j % 8 == 0:
            out[live[over]] = (rows[tau][over] >> (la[live] - lb[live] + tau)[over].astype(np.uint32)) & 1
            stay = ~over & (rows[tau] != 0)
            live, rows = live[stay], [r[stay] for r in rows]
            if not len(live):
                break
        at, left, c = a[live] + j, la[live] - j, buf[b[live] + j]
        match = np.zeros(len(live), np.uint32)
        for d in range(-tau, tau + 1):
            match |= ((buf[at + d] == c) & (left > d) & (j + d >= 0)).astype(np.uint32) << np.uint32(d + tau)
        new = [rows[0] & match]
        for e in range(1, tau + 1):
            new.append((rows[e] & match) | rows[e - 1] | (rows[e - 1] >> np.uint32(1)) | ((new[e - 1] << np.uint32(1)) & full))
        rows = new
        j += 1
    return out


def edit_within(x: bytes, y: bytes, tau: int) -> bool:
    """The same of one pair: a diagonal's place with so many edits goes straight to the next byte at which it differs."""
    if abs(len(x) - len(y)) > tau:
        return False
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)

    def slide(j: int, d: int) -> int:
        """The first place of y from j on where x, d bytes on, differs, or the end of either."""
        end, step = min(len(b), len(a) - d), 64
        while j < end:
            stop = min(end, j + step)
            differ = a[j + d : stop + d] != b[j:stop]
            k = int(differ.argmax())
            if differ[k]:
                return j + k
            j, step = stop, step * 4
        return j

    reach = {0: slide(0, 0)}
    for e in range(tau + 1):
        if e:
            step: dict[int, int] = {}
            for d, j in reach.items():
                for to, place in ((d, j + 1), (d - 1, j + 1), (d + 1, j)):
                    if abs(to) <= tau and place <= len(b) and 0 <= place + to <= len(a):
                        step[to] = max(step.get(to, -1), place)
            reach = {d: slide(j, d) for d, j in step.items()}
        if reach.get(len(a) - len(b), -1) >= len(b):
            return True
    return False


def alike(x: list[bytes], y: list[bytes], tau: int) -> np.ndarray:
    """Whether the lines of each pair are within tau."""
    lx, ly = np.array([len(v) for v in x], np.int64), np.array([len(v) for v in y], np.int64)
    out = np.zeros(len(x), bool)
    fits = np.abs(lx - ly) <= tau
    long = fits & (ly > LONG)
    out[long] = [edit_within(x[i], y[i], tau) for i in np.flatnonzero(long)]
    short = np.flatnonzero(fits & ~long)
    short = short[np.argsort(ly[short], kind="stable")]
    for part in (short[i : i + 4096] for i in range(0, len(short), 4096)):
        pad = b"\0" * (2 * tau + 1)
        buf = np.frombuffer(b"".join([pad, *[v for i in part for v in (x[i], y[i])], pad]), np.uint8)
        ends = len(pad) + np.cumsum(np.column_stack([lx[part], ly[part]]).ravel()).reshape(-1, 2)
        out[part] = banded(buf, ends[:, 0] - lx[part], lx[part], ends[:, 1] - ly[part], ly[part], tau)
    return out


def verified(pairs: DataFrame, lines: DataFrame, tau: int) -> DataFrame:
    """doc_id, line_no of the first line of each pair that is alike to the second."""
    x = lines.select("doc_id", "line_no", F.col("line").alias("x"))
    y = lines.select(F.col("doc_id").alias("lead_doc"), F.col("line_no").alias("lead_no"), F.col("line").alias("y"))

    def run(batches):
        for b in batches:
            keep = alike(b.column("x").to_pylist(), b.column("y").to_pylist(), tau)
            yield b.select(["doc_id", "line_no"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(x, ["doc_id", "line_no"]).join(y, ["lead_doc", "lead_no"])
    return joined.select("doc_id", "line_no", "x", "y").mapInArrow(run, "doc_id long, line_no long").distinct()


# ---- the rest ----------------------------------------------------------------------------------------------------


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(p) for p in parts], np.int64)
    e = np.cumsum(n)
    return np.frombuffer(b"".join(parts), np.uint8), e - n, e


def remainders(parts: list[bytes], tau: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(line, key, whether own, what is left) of the windows of each line; wanted: only those of this key, by line."""
    buf, s, e = joined(parts)
    who, key, begin, size, own = window_keys(buf, s, e, tau)
    if wanted is not None:
        at = np.flatnonzero(key == wanted[who])
        who, key, begin, size, own = who[at], key[at], begin[at], size[at], own[at]
    return who, key, own, [parts[w][:b] + parts[w][b + n :] for w, b, n in zip(who.tolist(), begin.tolist(), size.tolist())]


def follow(lines: list[bytes], paths: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(line, whether own, what is left) after the windows of a path of keys are cut out. paths: lines x levels."""
    who, own, left = np.arange(len(lines)), np.ones(len(lines), bool), lines
    for level in range(paths.shape[1]):
        at, _, is_own, left = remainders(left, tau, paths[who, level])
        who, own = who[at], own[at] & is_own
    return who, own, left


def byte_counts(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each line's bytes in 64 kinds, which an edit moves by 2 in sum, and a weighted sum of these, which it moves by 62 at most."""
    count = np.stack([np.bincount(np.frombuffer(x, np.uint8) & 63, minlength=64) for x in lines]).astype(np.int32)
    return count, count @ (mix(np.arange(1, 65, dtype=np.uint64)) % np.uint64(63)).astype(np.int32)


def plausible(c: dict, i: np.ndarray, j: np.ndarray, tau: int) -> np.ndarray:
    """Whether row i may be alike to row j: i asks, j answers and stands before it, one of the windows is an own segment, lengths and bytes are near enough."""
    ok = c["ask"][i] & c["answer"][j] & (c["place"][j] < c["place"][i]) & (c["own"][i] | c["own"][j])
    ok &= (np.abs(c["size"][i] - c["size"][j]) <= tau) & (np.abs(c["weigh"][i] - c["weigh"][j]) <= 62 * tau)
    return ok


def group_pairs(c: dict, left: list[bytes], group: np.ndarray, tau: int, levels: int):
    """Yields arrays (i, j) of rows that may be alike.

    The rows of a group share all keys so far; left is what remains of their
    lines. c: ask, answer, place (rank of the line), size, weigh, and own: whether all of the row's windows are own segments.
    """
    order = np.argsort(group, kind="stable")
    edge = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1], True])
    count = np.diff(edge)
    # groups of a few rows, many at once
    few = np.flatnonzero(np.repeat(count <= SMALL, count))
    after = (np.repeat(edge[1:], count) - np.arange(len(order)) - 1)[few]
    bounds = np.r_[0, np.cumsum(after)]
    lo = 0
    while lo < len(few):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 200_000, side="right")) - 1)
        reps = after[lo:hi]
        i = np.repeat(few[lo:hi], reps)
        j = order[i + 1 + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
        i = order[i]
        later = c["place"][i] > c["place"][j]
        i, j = np.where(later, i, j), np.where(later, j, i)
        ok = plausible(c, i, j, tau)
        yield i[ok], j[ok]
        lo = hi
    for g in np.flatnonzero(count > SMALL):
        rows = order[edge[g] : edge[g + 1]]
        if c["ask"][rows].any() and c["answer"][rows].any():
            for i, j in large_group({k: v[rows] for k, v in c.items()}, [left[x] for x in rows], tau, levels):
                yield rows[i], rows[j]


def large_group(c: dict, left: list[bytes], tau: int, levels: int):
    """The same of one group, by segments of the remainders; what is too short for these, or has been cut often enough, pair by pair."""
    size = np.array([len(x) for x in left])
    least = 4 * (tau + 1)
    short = np.arange(len(left)) if not levels else np.flatnonzero(size < least + tau)
    ask, answer = short[c["ask"][short]], short[c["answer"][short]]
    step = max(1, 1_000_000 // max(1, len(answer)))
    for part in (ask[x : x + step] for x in range(0, len(ask), step)):
        i, j = np.nonzero(plausible(c, part[:, None], answer[None, :], tau))
        yield part[i], answer[j]
    deep = np.flatnonzero(size >= least) if levels else short[:0]
    if len(deep):
        who, key, own, rest = remainders([left[x] for x in deep], tau)
        who = deep[who]
        longer = {k: v[who] for k, v in c.items()}
        longer["own"] &= own
        for i, j in group_pairs(longer, rest, key, tau, levels - 1):
            yield who[i], who[j]


def found_in(lines: list[bytes], paths: np.ndarray, group: np.ndarray, asks: np.ndarray, answers: np.ndarray, place: np.ndarray, tau: int) -> np.ndarray:
    """Which of the lines that ask are alike to an earlier line of their group that answers. The lines of a group have one path of keys."""
    gone = np.zeros(len(lines), bool)
    count, weigh = byte_counts(lines)
    size = np.array([len(x) for x in lines])
    who, own, left = follow(lines, paths, tau)
    held: list[np.ndarray] = []
    some = 0

    def settle():
        code = np.unique(np.concatenate(held))
        i, j = code // len(lines), code % len(lines)
        for lo in range(0, len(i), 100_000):
            x, y = i[lo : lo + 100_000], j[lo : lo + 100_000]
            near = ~gone[x] & (np.abs(count[x] - count[y]).sum(axis=1) <= 2 * tau)
            x, y = x[near], y[near]
            most = 4
            while len(x):  # a few partners of each line first: once found, a line needs no more
                nth = np.arange(len(x)) - np.searchsorted(x, x)
                now = nth < most
                hit = alike([lines[v] for v in x[now]], [lines[v] for v in y[now]], tau)
                gone[x[now][hit]] = True
                stay = ~now & ~gone[x]
                x, y, most = x[stay], y[stay], most * 4

    c = {"ask": asks[who], "answer": answers[who], "place": place[who], "size": size[who], "weigh": weigh[who], "own": own}
    for i, j in group_pairs(c, left, group[who], tau, LEVELS):
        if not len(i):
            continue
        held.append(who[i] * len(lines) + who[j])
        some += len(i)
        if some > 500_000:
            settle()
            held, some = [], 0
    if held:
        settle()
    return np.flatnonzero(gone)


def tiles(rows: DataFrame, tau: int) -> DataFrame:
    """doc_id, line_no of undecided lines that are alike to an earlier line of one of their paths.

    rows: path, cuts, doc_id, line_no, open (undecided), line. A path's lines
    are dealt to cuts by cuts tiles; a task holds one tile.
    """
    cut = rows.withColumn("cut", F.pmod(F.xxhash64("doc_id", "line_no"), F.col("cuts")).cast("int"))
    all_cuts = F.sequence(F.lit(0), F.col("cuts") - 1)
    one = F.col("cuts") == 1
    whole = cut.where(one).select("path", F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("open").alias("ask"), F.lit(True).alias("answer"), "doc_id", "line_no", "line")
    asks = cut.where(~one & F.col("open")).select("path", F.col("cut").alias("row"), F.explode(all_cuts).alias("col"), F.lit(True).alias("ask"), F.lit(False).alias("answer"), "doc_id", "line_no", "line")
    answers = cut.where(~one).select("path", F.explode(all_cuts).alias("row"), F.col("cut").alias("col"), F.lit(False).alias("ask"), F.lit(True).alias("answer"), "doc_id", "line_no", "line")
    dealt = whole.unionAll(asks).unionAll(answers).withColumn("key", F.xxhash64("path", "row", "col")).repartition("key").sortWithinPartitions("key")

    def found(t: pa.Table) -> pa.RecordBatch:
        """Of whole tiles, as many as a batch has."""
        doc, no = (t.column(c).to_numpy() for c in ("doc_id", "line_no"))
        place = np.empty(t.num_rows, np.int64)
        order = np.lexsort((no, doc))
        place[order] = np.cumsum(np.r_[False, (doc[order][1:] != doc[order][:-1]) | (no[order][1:] != no[order][:-1])])
        paths = t.column("path").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(t.num_rows, -1)
        at = found_in(t.column("line").to_pylist(), paths, t.column("key").to_numpy(), t.column("ask").to_numpy(), t.column("answer").to_numpy(), place, tau)
        return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(no[at])], ["doc_id", "line_no"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            t = t.combine_chunks()
            key = t.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield found(t.slice(0, last).combine_chunks())
            held = t.slice(last)
        if held is not None:
            yield found(held.combine_chunks())

    return dealt.mapInArrow(run, "doc_id long, line_no long").distinct()


def sized(rows: DataFrame) -> DataFrame:
    """rows of the paths that have two lines or more, one of them undecided, with cuts: the tiles that the path needs."""
    cuts = F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("bytes") / TILE_BYTES)).cast("int")
    busy = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("any"), cuts.alias("cuts")).where("any and n > 1")
    return rows.join(busy.select("path", "cuts"), "path")


def deeper(rows: DataFrame, tau: int) -> DataFrame:
    """rows of longer paths: each line by the windows of what its path leaves. Remainders too short for segments keep a path of their own."""

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 2048):
                part = b.slice(lo, 2048)
                path = part.column("path")
                paths = path.flatten().to_numpy().view(np.uint64).reshape(len(part), -1)
                who, _, left = follow(part.column("line").to_pylist(), paths, tau)
                at, key, _, _ = remainders(left, tau)
                at = who[at]
                code = np.unique(np.stack([at.astype(np.uint64), key], axis=1), axis=0)
                at, key = code[:, 0].astype(np.int64), code[:, 1]
                longer = np.concatenate([paths[at], key[:, None]], axis=1).view(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(longer.ravel()), longer.shape[1]).cast(pa.list_(pa.int64()))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([lists, *[part.column(c).take(take) for c in names]], ["path", *names])

    names = ["doc_id", "line_no", "open", "bytes"]
    return rows.select("path", *names, "line").mapInArrow(run, "path array<long>, doc_id long, line_no long, open boolean, bytes long")


def rest_of(rows: DataFrame, lines: DataFrame, scratch: Scratch, tau: int) -> DataFrame:
    """doc_id, line_no of the lines found by the rows (path, doc_id, line_no, open, bytes) of undecided and earlier lines."""
    found = None
    for level in range(LEVELS + 1):
        now = scratch.keep(sized(rows).join(lines, ["doc_id", "line_no"]))
        most = level == LEVELS
        part = scratch.keep(tiles(now if most else now.where("cuts = 1"), tau))
        found = part if found is None else found.unionAll(part)
        hot = now.where("cuts > 1")
        if most or hot.isEmpty():
            scratch.drop(now)
            return found
        rows = scratch.keep(deeper(hot, tau))
        scratch.drop(now)


# ---- all together ----------------------------------------------------------------------------------------------------


def first_lines(met: DataFrame) -> DataFrame:
    """key, doc_id, line_no of the first line of each key of several leaders, which has not met the rows of other batches."""
    lead = F.struct(F.col("lead_doc").alias("doc_id"), F.shiftright("lead_place", 2).alias("line_no"))
    ends = met.where("not decided").groupBy("key").agg(F.min(lead).alias("first"), F.max(lead).alias("last"))
    return ends.where("first <> last").select("key", "first.*")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, line_no, line (bytes) of the wanted lines."""
    lists = wanted.groupBy("doc_id").agg(F.collect_set("line_no").alias("nos"))

    def run(batches):
        for b in batches:
            doc, no, line, size = [], [], [], 0
            for d, text, nos in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("nos")):
                parts = text.as_buffer().to_pybytes().split(b"\n")
                for n in nos.values.to_pylist():
                    if n < len(parts):  # else of another row with this id
                        doc.append(d)
                        no.append(n)
                        line.append(parts[n])
                        size += len(parts[n])
                        if size > 4 << 20:
                            yield of(doc, no, line)
                            doc, no, line, size = [], [], [], 0
            yield of(doc, no, line)

    def of(doc, no, line):
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(no, pa.int64()), pa.array(line, pa.binary())], ["doc_id", "line_no", "line"])

    return docs.join(lists, "doc_id").select("doc_id", "text", "nos").mapInArrow(run, "doc_id long, line_no long, line binary")


def duplicate_lines(docs: DataFrame, spark: SparkSession, tau: int = TAU, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, line_no (from 0) of the lines to remove."""
    scratch = Scratch(spark, "lines")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    met = scratch.keep(meet(key_rows(docs, tau, min_bytes).repartition("key").sortWithinPartitions("key", "doc_id", "place")))
    release(spark)
    no, lead_no = F.shiftright("place", 2), F.shiftright("lead_place", 2)
    equal = scratch.keep(met.where("decided").select("doc_id", no.alias("line_no")).distinct())
    open_ = met.where("not decided").withColumns({"line_no": no, "lead_no": lead_no})
    pairs = open_.where(f"place & 3 = {INDEX} or lead_place & 3 = {INDEX}").select("doc_id", "line_no", "lead_doc", "lead_no").distinct()

    # the text of the lines that met another, once
    wanted = open_.select("doc_id", "line_no").unionAll(open_.select("lead_doc", "lead_no")).distinct()
    lines = scratch.keep(line_texts(docs, wanted))
    release(spark)

    near = scratch.keep(verified(pairs, lines, tau))
    gone = equal.unionAll(near).distinct()
    state = lines.select("doc_id", "line_no", F.octet_length("line").alias("bytes")).distinct().join(gone.withColumn("gone", F.lit(True)), ["doc_id", "line_no"], "left")
    rest = open_.select("key", "doc_id", "line_no", F.lit(True).alias("open")).unionByName(first_lines(met).withColumn("open", F.lit(False)))
    rest = rest.join(state, ["doc_id", "line_no"], "left").withColumn("open", F.col("open") & F.col("gone").isNull())
    rest = scratch.keep(rest.select(F.array("key").alias("path"), "doc_id", "line_no", "open", F.col("bytes").cast("long").alias("bytes")))
    scratch.drop(met)
    release(spark)
    found = rest_of(rest, lines, scratch, tau)
    scratch.drop(rest, lines)
    release(spark)
    return equal.unionAll(near).unionAll(found).distinct()


def dedup_lines(docs: DataFrame, spark: SparkSession, tau: int = TAU, min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs, all columns, with the text less its duplicate lines; removed: the numbers of the lines taken out, sorted; n_lines: lines before (0 for null). The two have a longer name where docs has such a column."""
    named = (free_name("removed", docs.columns), free_name("n_lines", docs.columns))
    own, back = shielded(docs, "doc_id", "text")
    columns = own.columns
    gone = duplicate_lines(own, spark, tau, min_bytes).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    left = own.join(gone, "doc_id", "left")

    def run(batches):
        for b in batches:
            texts, removed, count = [], [], []
            for text, nos in zip(b.column("text"), b.column("removed")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else None
                parts = 0 if raw is None else raw.count(b"\n") + 1
                cut = [n for n in nos.values.to_pylist() if n < parts] if nos.is_valid else []
                if cut:
                    drop = set(cut)
                    raw = b"\n".join(x for n, x in enumerate(raw.split(b"\n")) if n not in drop)
                texts.append(raw)
                removed.append(cut)
                count.append(parts)
            text = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*[text if c == "text" else b.column(c) for c in columns], pa.array(removed, pa.list_(pa.int32())), pa.array(count, pa.int64())], [*columns, "removed", "n_lines"])

    kinds = T.StructType([*own.schema.fields, T.StructField("removed", T.ArrayType(T.IntegerType())), T.StructField("n_lines", T.LongType())])
    return back(left.select(*columns, "removed").mapInArrow(run, kinds), *named)


def oracle(tau: int = TAU) -> str:
    """doc_id, n_lines, n_removed, kept_sha256 as DuckDB SQL."""
    return f"""
with l as materialized (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as no from documents),
u as materialized (select line, strlen(line) as n, min((doc_id, no)) as f from l where line <> '' group by line),
g as materialized (select distinct a.line from u a join u b on a.n >= {MIN_BYTES} and b.n >= {MIN_BYTES} and a.n between b.n - {tau} and b.n + {tau} and b.f < a.f where levenshtein(a.line, b.line) <= {tau}),
k as (select l.doc_id, l.no, l.line, l.line <> '' and (l.line in (select line from g) or (l.doc_id, l.no) > u.f) as gone from l left join u on u.line = l.line union all select doc_id, null, null, false from documents where text is null)
select doc_id, count(no)::bigint as n_lines, count(*) filter (coalesce(gone, false))::bigint as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by no) filter (not coalesce(gone, false)), '')) as kept_sha256 from k group by doc_id"""
