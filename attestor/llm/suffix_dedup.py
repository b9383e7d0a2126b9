"""Removal of repeated passages by suffix arrays.

A byte is removed if it lies in a string of ``window`` bytes that also starts earlier (in a document
with a smaller id, or earlier in the same one). Four steps find those strings without one suffix
array over everything:

1. *Anchors.* In every window the smallest hash of its 32-byte strings picks an anchor. Equal windows
   have equal anchors at equal places, so windows need only be compared where anchors agree. A run of
   windows with one anchor is a fragment (its windows and no more).
2. *Copies.* Fragments that are equal as a whole are classes: all but the earliest are removed as a
   whole, and the earliest represents its class in step 3. Members meet by hashes, first within the
   task that made them and then by anchor, so a passage in a third of all documents costs one row for
   each task. Every membership is then verified byte by byte: within the task at once; between tasks
   adjoining members of one source become one run, whose bytes visit the source's text. Hashes only
   propose; a collision raises an error (and another SEED goes around it).
3. *Suffix arrays.* Anchors that remain in different fragments get their texts. For each bucket of
   anchors a suffix array is built over its fragments by two-stage sorting: suffixes smaller than
   their successors are sorted directly, all others are induced from them by one scan over the
   buckets of first bytes. Neighbours with a common prefix of a whole window are the same string, and
   all but the earliest of such a class are removed.
4. *Assembly.* The removed windows of a document, merged, are cut out of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import numbered, partitions, prepare, size_of, unused

WINDOW = 100
_GRAM = 32  # bytes of an anchor
_CHUNK = 1 << 18  # window starts hashed at once
_FLUSH = 600_000  # anchors that a task gathers before it hands them on
SEED = 20
#: Bytes of the table's files that one slice of documents holds, about.
SLICE_BYTES = 8 << 20
_BYTE = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)
_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _join(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Hash of a concatenation from the hashes of both halves."""
    h = a * _MULTIPLY[level]
    h += b
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position on (by doubling)."""
    h = _BYTE[data]
    for level in range(5):
        s = 1 << level
        h = _join(h[:-s], h[s:], level)
    return h


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values (by doubling)."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(anchor hash, fragment hash, first window, number of windows, bytes before the anchor) of all runs of windows of one text."""
    count = len(data) - window + 1
    parts = []
    for at in range(0, count, _CHUNK):
        piece = data[at : min(at + _CHUNK, count) + window - 1]
        grams = gram_hashes(piece)
        place = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64((1 << 20) - 1)
        # leftmost of the smallest: the place breaks ties of the hash's upper bits
        where = (_smallest(grams & ~low | place, window - _GRAM + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        n = np.diff(np.concatenate((first, [len(where)])))
        anchor, length = where[first], n + window - 1
        h, before = grams[anchor] * _MULTIPLY[5], anchor - first
        f = (length.astype(np.uint64) << np.uint64(16)) + before.astype(np.uint64)
        # 64-byte strings at the start, in the middle and at the end cover a fragment of < 3 * 64 bytes
        for k, to in enumerate((first, first + (length - 2 * _GRAM) // 2, first + length - 2 * _GRAM)):
            f = _join(f, _join(grams[to], grams[to + _GRAM], 5) * _MULTIPLY[6], k)
        parts.append((h ^ h >> np.uint64(32), f, first + at, n, before))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _sort_directly(text: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` bytes: by four bytes first, then part by part, so that few strings are spelled out at once."""
    padded = np.concatenate([text, np.zeros(depth + 4, dtype=np.uint8)])
    strings = np.lib.stride_tricks.as_strided(padded, shape=(len(text), depth), strides=(1, 1))
    four = np.zeros(len(suffixes), dtype=np.uint32)
    for k in range(4):
        four = four << np.uint32(8) | padded[suffixes + k]
    by = np.argsort(four, kind="stable")
    suffixes, four = suffixes[by], four[by]
    cuts = np.concatenate((np.flatnonzero(four[1:] != four[:-1]) + 1, [len(four)]))
    at = 0
    while at < len(four):
        to = cuts[max(np.searchsorted(cuts, at + 100_000, side="right") - 1, np.searchsorted(cuts, at, side="right"))]
        part = suffixes[at:to]
        suffixes[at:to] = part[np.argsort(np.ascontiguousarray(strings[part]).view(f"S{depth}").ravel(), kind="stable")]
        at = to
    return suffixes


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of a byte string (which ends in the byte 0), right to ``depth`` bytes, by two-stage sorting."""
    n = len(text)
    t = text.astype(np.int16)
    step = np.empty(n, dtype=np.int16)
    step[:-1], step[-1] = np.sign(t[1:] - t[:-1]), -1
    # a run of equal bytes goes the way of the byte after it
    at = np.where(step != 0, np.arange(n), n)
    rises = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
    # stage one: suffixes smaller than their successors, sorted directly
    small = _sort_directly(text, np.flatnonzero(rises).astype(np.int32), depth)
    starts = np.searchsorted(t[small], np.arange(257))
    # stage two: one scan over the buckets of first bytes puts each other suffix behind its successor
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        induced = [np.concatenate(waiting[c])] if waiting[c] else []
        while induced and len(induced[-1]):
            before = induced[-1][induced[-1] > 0] - 1
            induced.append(before[(t[before] == c) & ~rises[before]])
        bucket = np.concatenate([*induced, small[starts[c] : starts[c + 1]]])
        out.append(bucket.astype(np.int32))
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        if len(before):
            order = np.argsort(t[before], kind="stable")
            before = before[order]
            cuts = np.flatnonzero(np.diff(t[before])) + 1
            for group in np.split(before, cuts):
                waiting[t[group[0]]].append(group)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in the list, at most ``most`` (first: 0)."""
    padded = np.concatenate([text, np.zeros(most, dtype=np.uint8)])
    strings = np.lib.stride_tricks.as_strided(padded, shape=(len(text), most), strides=(1, 1))
    out = np.zeros(len(suffixes), dtype=np.int64)
    for at in range(1, len(suffixes), 20_000):
        rows = np.arange(at, min(at + 20_000, len(suffixes)))
        differ = strings[suffixes[rows]] != strings[suffixes[rows - 1]]
        out[rows] = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    return out


def repeated_windows(fragments: list[bytes], order: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """(fragment, window) rows of the windows that occur earlier; order: (fragments, keys) gives each fragment's place, its last key that of its first window in the document."""
    lengths = np.fromiter(map(len, fragments), dtype=np.int64, count=len(fragments))
    # 0 parts the fragments; a text's own zero bytes become 255, which no UTF-8 text holds
    text = np.frombuffer(b"\0".join(f.replace(b"\0", b"\xff") for f in fragments) + b"\0", dtype=np.uint8)
    begin = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(fragments), dtype=np.int32), lengths + 1)
    suffixes = sort_suffixes(text, window)
    suffixes = suffixes[suffixes - begin[owner[suffixes]] <= lengths[owner[suffixes]] - window]
    if not len(suffixes):
        return np.empty((0, 2), dtype=np.int64)
    classes = np.cumsum(common_prefixes(text, suffixes, window) < window)
    f = owner[suffixes]
    start = suffixes - begin[f]
    keys = [order[f, -1] + start, *[order[f, k] for k in range(order.shape[1] - 2, -1, -1)], classes]
    by = np.lexsort(keys)
    later = np.concatenate(([False], classes[by][1:] == classes[by][:-1]))
    return np.stack([f[by][later], start[by][later]], axis=1)


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, non-touching spans that cover the same places."""
    if not len(start):
        return start, end
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.concatenate((new[1:], [True]))]


_LAST = np.iinfo(np.int64).max
_TYPES = {"rid": np.int64, "doc": np.int64, "h": np.uint64, "f": np.uint64, "start": np.uint32, "n": np.uint8, "before": np.uint8, "of": np.int64, "of_start": np.uint32}
_NAMES = ["kind", "at", *_TYPES]
_ROW = "kind int, at int, " + ", ".join(f"{c} binary" for c in _TYPES)
#: Kinds of rows: fragments; spans to remove; spans that wait for their verification; fragments whose texts are wanted.
_ANCHORS, _SPANS, _COPIES, _WANTED = 0, 1, 2, 3


class HashCollisionError(ValueError):
    """Two different fragments have the same hashes."""

    def __init__(self) -> None:
        super().__init__("two different fragments have the same 128 bits of hashes; change suffix_dedup.SEED")


#: Anchors with more different fragments than this are told apart further, and how that is marked (in n).
HOT_ANCHOR, _HOT = 256, 128
#: Windows, by their distance from the anchor, that are then kept together.
_STRIP = 23


def _slice_of(rid: np.ndarray, slices: int) -> np.ndarray:
    """Slice of a row: some rows in turn, starting elsewhere for each partition (the upper bits)."""
    return ((rid >> 33) * 31 + ((rid & (1 << 33) - 1) >> 5)) % slices


def _slice_column(slices: int) -> Column:
    rid = F.col("rid")
    return ((F.shiftright(rid, 33) * 31 + F.shiftright(rid.bitwiseAND((1 << 33) - 1), 5)) % slices).cast("int")


def _rows(kind: int, key: np.ndarray, **columns: np.ndarray) -> Iterator[tuple]:
    """One row of packed columns for each value of key."""
    if not len(key):
        return
    by = np.argsort(key, kind="stable")
    values, first = np.unique(key[by], return_index=True)
    for at, rows in zip(values.tolist(), np.split(by, first[1:]), strict=True):
        yield (kind, at, *[columns[c][rows].astype(_TYPES[c]).tobytes() if c in columns else None for c in _NAMES[2:]])


def _unpack(frame: pd.DataFrame, *names: str) -> list[np.ndarray]:
    packed = [np.frombuffer(b"".join(frame[c]), dtype=_TYPES[c]) for c in names]
    return [x if x.dtype.itemsize == 8 else x.astype(np.int64) for x in packed]


def _earliest(h, f, doc, rid, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(representatives, other members, the others' representatives) of the classes of equal hashes."""
    by = np.lexsort((start, rid, doc, f, h))
    first = np.concatenate(([True], (h[by][1:] != h[by][:-1]) | (f[by][1:] != f[by][:-1])))
    of = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
    return by[first], by[~first], of[~first]


def _find_anchors(buckets: int, slices: int, window: int):
    """Step 1, and step 2 within the task."""

    def flush(held: list[tuple]) -> pd.DataFrame:
        texts = [x[0] for x in held]
        rid, doc, h, f, start, n, before = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
        keep, drop, of = _earliest(h, f, doc, rid, start)
        text_of, first, last = np.repeat(np.arange(len(held)), [len(x[1]) for x in held]), start.tolist(), (start + n + window - 1).tolist()
        for i, j, t, u in zip(drop.tolist(), of.tolist(), text_of[drop].tolist(), text_of[of].tolist(), strict=True):
            if texts[t][first[i] : last[i]] != texts[u][first[j] : last[j]]:
                raise HashCollisionError
        keep = np.sort(keep)  # documents' numbers in runs, for the shuffle's compression
        rows = list(_rows(_ANCHORS, (h[keep] % np.uint64(buckets)).astype(np.int64), rid=rid[keep], doc=doc[keep], h=h[keep], f=f[keep], start=start[keep], n=n[keep], before=before[keep]))
        # spans ride along in any bucket
        if len(drop):
            rows += [(kind, at % buckets, *rest) for kind, at, *rest in _rows(_SPANS, _slice_of(rid[drop], slices), rid=rid[drop], start=start[drop], n=n[drop])]
        return pd.DataFrame(rows, columns=_NAMES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for rid, doc, text in zip(batch["rid"], batch["doc"], batch["text"], strict=True):
                data = np.frombuffer(text, dtype=np.uint8)
                if len(data) >= window:
                    found = anchors(data, window)
                    h = found[0]
                    held.append((text, np.full(len(h), rid), np.full(len(h), doc), *found))
                    size += len(h)
                if size >= _FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _merge_copies(slices: int):
    """Step 2 over all tasks: spans of later copies, and the fragments whose texts are wanted."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        spans = frame[frame["kind"] == _SPANS]
        if len(spans):
            rid, start, n = _unpack(spans, "rid", "start", "n")
            out += _rows(_SPANS, _slice_of(rid, slices), rid=rid, start=start, n=n)
        found = frame[frame["kind"] == _ANCHORS]
        if len(found):
            rid, doc, h, f, start, n, before = _unpack(found, "rid", "doc", "h", "f", "start", "n", "before")
            keep, drop, of = _earliest(h, f, doc, rid, start)
            out += _rows(_COPIES, _slice_of(rid[drop], slices), rid=rid[drop], start=start[drop], n=n[drop], of=rid[of], of_start=start[of])
            _, which, count = np.unique(h[keep], return_inverse=True, return_counts=True)
            count = count[which]
            n = n + _HOT * np.isin(np.arange(len(n)), keep[count > HOT_ANCHOR])
            keep = keep[count > 1]
            out += _rows(_WANTED, _slice_of(rid[keep], slices), rid=rid[keep], doc=doc[keep], h=h[keep], start=start[keep], n=n[keep], before=before[keep])
        return pd.DataFrame(out, columns=_NAMES)

    return run


def _strips(start: int, n: int, before: int) -> Iterator[tuple[int, int, int]]:
    """(first window, windows, strip) for each strip of a run: windows that begin about as far before the anchor."""
    for strip in range((before - n + 1) // _STRIP, before // _STRIP + 1):
        low, high = max(before - (strip + 1) * _STRIP + 1, 0), min(before - strip * _STRIP, n - 1)
        if low <= high:
            yield start + low, high - low + 1, strip


#: Kinds of the rows that _fetch makes, and their columns.
_FRAGMENT, _RUN = 0, 1
_FETCHED = "kind int, at int, rid long, doc long, start long, key long, bytes binary"


def _runs_of_copies(copies: pd.DataFrame, texts: dict[int, bytes], slices: int, window: int) -> Iterator[tuple]:
    """Runs of adjoining members whose representatives adjoin as well: where the representatives are, and the members' bytes; equal runs once."""
    rid, start, n, of, of_start = _unpack(copies, "rid", "start", "n", "of", "of_start")
    by = np.lexsort((start, rid))
    rid, start, n, of, of_start = (x[by] for x in (rid, start, n, of, of_start))
    goes_on = (rid[1:] == rid[:-1]) & (start[1:] == start[:-1] + n[:-1]) & (of[1:] == of[:-1]) & (of_start[1:] - start[1:] == of_start[:-1] - start[:-1])
    first = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    last = np.concatenate((first[1:], [len(rid)])) - 1
    seen = set()
    for r, a, b, source, at in zip(rid[first].tolist(), start[first].tolist(), (start[last] + n[last] + window - 1).tolist(), of[first].tolist(), of_start[first].tolist(), strict=True):
        run = (source, at, texts[r][a:b])
        if run not in seen:
            seen.add(run)
            yield _RUN, int(_slice_of(np.array([source]), slices)[0]), source, 0, at, 0, run[2]


def _fetch(buckets: int, window: int):
    """Texts of the wanted fragments, and of the runs of copies, of a slice of documents.

    A short common phrase can be the anchor of a different fragment in each of very many documents.
    The fragments of such an anchor are cut into strips, which meet by all the bytes that the strip's
    windows share (78 at least) in place of the anchor's 32; most of them then meet nothing.
    """

    def run(found: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        texts = dict(zip(docs["rid"], docs["text"], strict=True))
        copies, wanted = found[found["kind"] == _COPIES], found[found["kind"] == _WANTED]
        if len(copies):
            rows += _runs_of_copies(copies, texts, buckets, window)
        if len(wanted):
            columns = _unpack(wanted, "rid", "doc", "h", "start", "n", "before")
            for rid, doc, h, start, n, before in zip(*(x.tolist() for x in columns), strict=True):
                text = texts[rid]
                if n < _HOT:
                    rows.append((_FRAGMENT, h % buckets, rid, doc, start, h - (1 << 63), text[start : start + n + window - 1]))
                    continue
                anchor = start + before
                for first, count, strip in _strips(start, n - _HOT, before):
                    shared = text[anchor - strip * _STRIP : anchor - (strip + 1) * _STRIP + 1 + window]
                    key = xxhash.xxh64_intdigest(shared, strip)
                    rows.append((_FRAGMENT, key % buckets, rid, doc, first, key - (1 << 63), text[first : first + count + window - 1]))
        return pd.DataFrame(rows, columns=["kind", "at", "rid", "doc", "start", "key", "bytes"])

    return run


#: Bytes of fragments that one suffix array is built over (more only where one anchor has more).
_ARRAY = 2_000_000


def _compare(slices: int, window: int):
    """Step 3 for one bucket of anchors, and the verification of the runs whose sources are in one slice of documents."""

    def run(frame: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        runs, frame = frame[frame["kind"] == _RUN], frame[frame["kind"] == _FRAGMENT]
        if len(runs):
            texts = dict(zip(docs["rid"], docs["text"], strict=True))
            for rid, start, copy in zip(runs["rid"], runs["start"], runs["bytes"], strict=True):
                if texts[rid][start : start + len(copy)] != copy:
                    raise HashCollisionError
        if not len(frame):
            return pd.DataFrame([], columns=_NAMES)
        keys, order = frame["key"].to_numpy(), frame[["doc", "rid", "start"]].to_numpy(dtype=np.int64)
        fragments = frame["bytes"].to_numpy()
        by = np.lexsort((order[:, 2], order[:, 1], order[:, 0], keys))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys[by])) + 1, [len(by)]))
        spans, batch, size = [], [], 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            first: dict[bytes, int] = {}
            for i in by[a:b].tolist() if b - a > 1 else ():
                if first.setdefault(fragments[i], i) != i:  # a copy of an earlier fragment
                    spans.append((i, 0, len(fragments[i]) - window + 1))
            if len(first) > 1:
                batch += first.values()
                size += sum(map(len, first))
            if size >= _ARRAY:
                spans += _later_runs(fragments, order, np.array(batch), window)
                batch, size = [], 0
        if batch:
            spans += _later_runs(fragments, order, np.array(batch), window)
        if not spans:
            return pd.DataFrame([], columns=_NAMES)
        i, w, n = np.array(spans, dtype=np.int64).T
        rid = order[i, 1]
        return pd.DataFrame(list(_rows(_SPANS, _slice_of(rid, slices), rid=rid, start=order[i, 2] + w, n=n)), columns=_NAMES)

    return run


def _later_runs(fragments: np.ndarray, order: np.ndarray, rows: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(row, first window, windows) of the runs of windows that occur earlier in the given fragments."""
    later = repeated_windows(fragments[rows].tolist(), order[rows], window)
    if not len(later):
        return []
    later = later[np.lexsort((later[:, 1], later[:, 0]))]
    f, w = later.T
    first = np.flatnonzero(np.concatenate(([True], (f[1:] != f[:-1]) | (w[1:] != w[:-1] + 1))))
    n = np.diff(np.concatenate((first, [len(f)])))
    return list(zip(rows[f[first]].tolist(), w[first].tolist(), n.tolist(), strict=True))


def _whole(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans shrunk to whole UTF-8 characters."""
    out = []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _assemble(window: int, whole_characters: bool):
    """Step 4 for one slice of documents."""

    def run(spans: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        by_rid: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if len(spans):
            rid, start, n = _unpack(spans, "rid", "start", "n")
            by = np.argsort(rid, kind="stable")
            ids, first = np.unique(rid[by], return_index=True)
            for one, rows in zip(ids.tolist(), np.split(by, first[1:]), strict=True):
                by_rid[one] = merge_spans(start[rows], start[rows] + n[rows] + window - 1)
        out = []
        none = np.empty(0, dtype=np.int64)
        for rid, text in zip(docs["rid"], docs["text"], strict=True):
            start, end = by_rid.get(rid, (none, none))
            if whole_characters:
                start, end = _whole(text, start, end)
            left, kept = 0, []
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                kept.append(text[left:a])
                left = b
            kept = b"".join([*kept, text[left:]])
            out.append((len(text), len(text) - len(kept), start, end, kept))
        rest = pd.DataFrame(out, columns=["n_bytes", "n_removed", "starts", "ends", "kept"])
        return pd.concat([docs[["rid", "id"]].reset_index(drop=True), rest], axis=1)

    return run


def find_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, whole_characters: bool = False, row_column: str | None = None) -> DataFrame:
    """(rid, id, n_bytes, n_removed, starts, ends, kept): what is removed of every document.

    ``starts`` and ``ends`` are the maximal removed runs in bytes, ``kept`` the bytes that remain
    (a cut may fall within a character, unless ``whole_characters`` keeps those in full). A null text is the empty text. Rows with the same
    id stand in the table's order, which is also their order of precedence; null ids come after all
    others. ``rid`` numbers the rows of docs (``row_column``, if the caller has numbered them). An
    empty table gives an empty result; other columns are not read. A task holds one slice of the
    documents, of about SLICE_BYTES of their files whatever the table's size.
    """
    spark = prepare(docs.sparkSession)
    slices = buckets = max(4 * partitions(spark), -(-size_of(docs) // SLICE_BYTES))
    if row_column is None:
        row_column = unused(docs, "__rid")
        docs = numbered(docs, row_column)
    rows = docs.select(F.col(row_column).alias("rid"), F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    doc = F.coalesce(F.col("id").cast("long"), F.lit(int(_LAST))).alias("doc")

    found = rows.select("rid", doc, "text").mapInPandas(_find_anchors(buckets, slices, window), _ROW)
    merged = found.groupBy("at").applyInPandas(_merge_copies(slices), _ROW).checkpoint()

    kind = docs.schema[id_column].dataType.simpleString()
    sliced = rows.select(_slice_column(slices).alias("at"), "rid", "id", "text").groupBy("at")
    wanted = merged.where(F.col("kind").isin(_COPIES, _WANTED)).groupBy("at")
    fetched = wanted.cogroup(sliced).applyInPandas(_fetch(buckets, window), _FETCHED).groupBy("at")
    compared = fetched.cogroup(sliced).applyInPandas(_compare(slices, window), _ROW)
    spans = merged.where(F.col("kind").isin(_SPANS, _COPIES)).unionByName(compared).groupBy("at")
    done = spans.cogroup(sliced).applyInPandas(_assemble(window, whole_characters), f"rid long, id {kind}, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary")
    return done.withColumnRenamed("id", id_column)


#: DuckDB SQL for the query over find_repeats(): every window as a string of bytes.
ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, s, b[s + 1:s + 100] AS w FROM (SELECT doc_id, b, unnest(range(n - 99)) AS s FROM n WHERE n >= 100)),
f AS (SELECT w, min((doc_id, s)) AS first FROM w GROUP BY w),
l AS (SELECT doc_id, s FROM w JOIN f USING (w) WHERE (doc_id, s) <> first),
g AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM l),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g),
r AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS e FROM i GROUP BY ALL),
k AS (SELECT doc_id, run, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY run), 0) AS p FROM r),
c AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, max(e) AS last, list(b[p + 1:a] ORDER BY run) AS pieces FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN last IS NULL THEN sha256(b) ELSE sha256(list_reduce(list_append(pieces, b[last + 1:]), lambda x, y: x || y)) END AS kept_sha256
FROM n LEFT JOIN c USING (doc_id)"""
