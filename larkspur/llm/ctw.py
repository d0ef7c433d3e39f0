"""Language-model scores by context-tree weighting over bytes, with a unigram baseline over words.

A text is its words, lower-cased and joined by single spaces, and an end byte. A byte's contexts, each refining the one
before, are nothing; one, two and three bytes before it as one of 32 classes (letters keep their identity); and the four,
five, six and seven bytes before it as they are. The next byte is decomposed into eight binary decisions; each decision has,
for every context, a Krichevsky-Trofimov estimate, and the tree's weighted probability mixes all of them.

Texts are written once in blocks of about 8 MB, each one compressed row. A block asks for its distinct words and its distinct
grams (seven bytes and the byte after them) with their counts in training documents; grams go in ascending order as packed
differences, which takes a byte or two each. Grams that share the nearest four bytes belong to one bucket, words go by a
hash. What a bucket was asked is kept as a written table, which grows with the corpus. From it come the trees below class
contexts; the class contexts, at most 32^3, are weighted in the driver from sums over buckets, and go back to the buckets,
which answer every block in the order in which it asked. The block then reads its texts again and adds up.

A bucket holds its distinct grams in memory, so a bucket grows with its most frequent four bytes. Answers are rounded to
2^-16 of a power of ten for each byte, beyond which nothing is lost: no gram, word or text is left out.

Defined results: a null or empty text has no words, only the end; repeated rows are separate documents that all count; a
null doc_id counts as empty text in the fold; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

DEPTH, CLASSES, END = 3, 32, b"\n"
CELLS = CLASSES**DEPTH * 256
#: Lengths of the contexts of bytes as they are; a gram is the longest of them and the next byte, the nearest bytes lowest.
LENGTHS = (4, 5, 6, 7)
#: Answers are whole multiples of 1 / STEPS of a power of ten.
STEPS = 1 << 16


def class_table() -> bytes:
    """Class of each byte: 0 white space and control, 1-26 letters, 27 digits, 28-29 punctuation, 30-31 UTF-8."""
    kinds = bytearray(256)
    for b in range(256):
        c = chr(b)
        kinds[b] = 0 if b <= 32 else ord(c.lower()) - 96 if b < 128 and c.isalpha() else 27 if c.isdigit() and b < 128 else 28 if c in ".,;:!?" else 29 if b < 128 else 30 if b < 0xA8 else 31
    return bytes(kinds)


CLASS_OF = class_table()


def cells(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Cell of every byte of joined texts: its context's classes, the nearest last, then the byte. Texts begin at starts;
    before a text stands white space."""
    kinds = np.frombuffer(data.translate(CLASS_OF), np.uint8).astype(np.int32)
    out = np.zeros(len(data), np.int32)
    for back in range(DEPTH, 0, -1):
        shifted = np.zeros(len(data), np.int32)
        shifted[back:] = kinds[:-back]
        for i in range(back):  # a context does not reach into the text before
            at = starts + i
            shifted[at[at < len(data)]] = 0
        out = out * CLASSES + shifted
    return out * 256 + np.frombuffer(data, np.uint8)


def normal(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def parts_of(batches: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[tuple[list, ...]]:
    """Columns of rows in parts of about `size` bytes of text (the second column), one long text at least."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        first = total = 0
        for i, t in enumerate(columns[1]):
            total += len(t or b"") + 1
            if total >= size or i + 1 == batch.num_rows:
                yield tuple(c[first : i + 1] for c in columns)
                first, total = i + 1, 0


def ranked(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of each code among the distinct ones, and those, ascending; all codes are below size."""
    if size > max(1 << 24, 4 * len(codes)):
        found, place = np.unique(codes, return_inverse=True)
        return place, found
    there = np.zeros(size, bool)
    there[codes] = True
    found, place = np.flatnonzero(there), np.empty(size, np.int32)
    place[found] = np.arange(len(found), dtype=np.int32)
    return place[codes], found


def runs_of(texts: list[bytes], tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of all bytes of the texts, turned and in order: the distinct ones, where the run of each begins, and the tag of
    each one's text (a small number). Before a text stands white space.

    Bytes, then threes and fours of them are numbered in their order, so that a gram and its tag fit one number to sort."""
    far = LENGTHS[-1]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + far
    data = np.frombuffer(b"".join(b" " * far + t for t in texts), np.uint8)
    inside = np.ones(len(data), bool)
    inside[((np.cumsum(sizes) - sizes)[:, None] + np.arange(far)).ravel()] = False
    alphabet = np.flatnonzero(np.bincount(data, minlength=256)).astype(np.uint64)
    a, numbers = len(alphabet), np.zeros(256, np.uint8)
    numbers[alphabet.astype(np.int64)] = np.arange(a)
    symbols = numbers[data]
    codes = symbols[:-2].astype(np.int32)
    for i in (1, 2):
        codes *= a
        codes += symbols[i : len(data) - 2 + i]
    three, found = ranked(codes, a**3)  # of bytes i to i + 2
    threes = alphabet[found // a // a] << np.uint64(16) | alphabet[found // a % a] << np.uint64(8) | alphabet[found % a]
    kind = np.int32 if len(threes) * a < 1 << 31 else np.int64
    codes = three[:-1].astype(kind)
    codes *= a
    codes += symbols[3:]
    four, found = ranked(codes, len(threes) * a)  # of bytes i to i + 3
    fours = threes[found // a] << np.uint64(8) | alphabet[found % a]
    del codes
    # a gram ends at byte i: its nearest four are i - 4 to i - 1, its farthest three i - 7 to i - 5
    near, low = four[far - 4 : -1], three[: len(data) - far].astype(kind)
    low *= a
    low += symbols[far:]
    del four, three
    bits, width = int(len(threes) * a - 1).bit_length(), int(tags.max(initial=0)).bit_length()
    codes = near.astype(np.uint64)
    codes <<= np.uint64(bits)
    codes |= low.astype(np.uint64)
    del near, low
    codes, tags = codes[inside[far:]], np.repeat(tags, sizes - far)
    if bits + int(len(fours) - 1).bit_length() + width > 64:
        order = np.argsort(codes)
        codes, tags = codes[order], tags[order]
    else:
        codes <<= np.uint64(width)
        codes |= tags.astype(np.uint64)
        codes.sort()
        tags = (codes & np.uint64((1 << width) - 1)).astype(tags.dtype)
        codes >>= np.uint64(width)
    first = np.flatnonzero(first_ones(codes))
    codes = codes[first]
    low = (codes & np.uint64((1 << bits) - 1)).astype(np.int64)
    return fours[(codes >> np.uint64(bits)).astype(np.int64)] << np.uint64(32) | threes[low // a] << np.uint64(8) | alphabet[low % a], first, tags


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving the argument up by 8."""
    y, shift = x + 8.0, np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def weighted(counts: np.ndarray, deeper: np.ndarray | None = None) -> np.ndarray:
    """log10 P(byte | context) for all cells: log10 of the product over eight decisions of the mixed probabilities.

    deeper: for a tree that goes on below class contexts, the log weight of what is below, by context and node (a decision's
    node is 2^bit and the prefix). Then the result has, by context and node, what class contexts add to the probability of
    0 and of 1, and the share that passes to longer contexts."""
    full = counts.reshape(CLASSES**DEPTH, 256)
    logs = np.zeros((CLASSES**DEPTH, 256) if deeper is None else (CLASSES**DEPTH, 256, 3), np.float32)
    # decision `bit` has 2^bit nodes, one for each prefix; some nodes at a time, so that the arrays stay small
    for bit, low, high in [(bit, low, min(low + 16, 1 << bit)) for bit in range(8) for low in range(0, 1 << bit, 16)]:
        width, nodes = 1 << (8 - bit), high - low
        pairs = full[:, low * width : high * width].reshape(-1, nodes, 2, width // 2).sum(axis=3).astype(np.float64)
        levels = [pairs]  # depth 3, 2, 1, 0; the farthest class leads, so summing over it gives the shorter context
        for depth in range(DEPTH - 1, -1, -1):
            levels.append(levels[-1].reshape(CLASSES, CLASSES**depth, nodes, 2).sum(axis=0))
        inside, share = None, []
        for depth, pair in zip(range(DEPTH, -1, -1), levels, strict=True):
            a, b = pair[..., 0], pair[..., 1]
            own = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)
            if depth == DEPTH and deeper is None:
                both, stay = own, None
            else:
                below = deeper.reshape(-1, 256)[:, (1 << bit) + low : (1 << bit) + high] if depth == DEPTH else inside.reshape(CLASSES, CLASSES**depth, nodes).sum(axis=0)
                both = np.logaddexp(own, below) - np.log(2)
                stay = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
            share.append(stay)
            inside = both
        mix = None
        for depth in range(DEPTH + 1):  # from the shortest context: stay there, or pass to the longer one
            pair, stay = levels[DEPTH - depth], share[DEPTH - depth]
            kt = (pair + 0.5) / (pair.sum(axis=-1, keepdims=True) + 1)
            here = 1.0 if depth == 0 else np.broadcast_to(go, (CLASSES, *go.shape)).reshape(CLASSES**depth, nodes)  # noqa: F821
            stop = here if stay is None else here * stay
            lower = 0.0 if mix is None else np.broadcast_to(mix, (CLASSES, *mix.shape)).reshape(CLASSES**depth, nodes, 2)
            mix = lower + np.asarray(stop)[..., None] * kt
            go = None if stay is None else here * (1 - stay)  # noqa: F841
        if deeper is not None:
            logs[:, (1 << bit) + low : (1 << bit) + high] = np.concatenate([mix, go[..., None]], axis=-1)
            continue
        step = np.log10(mix).astype(np.float32)
        logs[:, low * width : high * width] += np.repeat(step.reshape(CLASSES**DEPTH, 2 * nodes), width // 2, axis=1)
    return logs.ravel() if deeper is None else logs.reshape(-1, 3)


class Kt:
    """log of the estimate of a zeros and b ones, by tables where the counts are small."""

    def __init__(self, size: int = 1 << 12):
        self.size, n = size, np.arange(size, dtype=np.float64)
        self.half, self.whole = log_gamma(n + 0.5), log_gamma(n + 1) + np.log(np.pi)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total, top = a + b, self.size - 1
        out = self.half[np.minimum(a, top)] + self.half[np.minimum(b, top)] - self.whole[np.minimum(total, top)]
        out[total == 0] = 0.0
        large = np.flatnonzero(total > top)
        x, y = a[large].astype(np.float64), b[large].astype(np.float64)
        out[large] = log_gamma(x + 0.5) + log_gamma(y + 0.5) - log_gamma(x + y + 1) - np.log(np.pi)
        return out


def class_contexts(grams: np.ndarray) -> np.ndarray:
    kinds, out = np.frombuffer(CLASS_OF, np.uint8), np.zeros(len(grams), np.int64)
    for back in range(DEPTH, 0, -1):
        out = out * CLASSES + kinds[(grams >> np.uint64(8 * back)).astype(np.uint8)]
    return out


def decisions(grams: np.ndarray, n: np.ndarray, chances: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """For each bit, of distinct, sorted grams: nodes of class contexts (context * 256 + node) with the log weights of the
    shortest contexts of bytes below them, and, where asked for, for each gram the chance of its bit below class contexts."""
    kt, levels, ups = Kt(), [(grams, n)], []
    for length in LENGTHS[-2::-1]:
        keys, up = np.unique(levels[-1][0] & np.uint64((1 << 8 * (length + 1)) - 1), return_inverse=True)
        levels.append((keys, np.bincount(up, levels[-1][1], len(keys)).astype(np.int64)))
        ups.append(up)
    for bit in range(8):
        inside = firsts = rows = p = None
        for i, (keys, n_of) in enumerate(levels):  # from the longest context
            prefix = keys >> np.uint64(8 - bit)
            first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
            node = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
            one = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            b = np.add.reduceat(np.where(one, n_of, 0), first)
            a = np.add.reduceat(n_of, first) - b
            own, taken = kt(a, b), (np.where(one, b[node], a[node]) + 0.5) / (a + b + 1.0)[node] if chances else None
            if i == 0:
                inside, p = own, taken
            else:
                # the nodes of the longer context, each by its first gram, under those of this one
                below = np.bincount(node[ups[i - 1][firsts]], inside, len(first))
                inside = np.logaddexp(own, below) - np.log(2)
                if chances:
                    rows = ups[i - 1] if rows is None else ups[i - 1][rows]
                    stay = (1 / (1 + np.exp(np.clip(below - own, -700, 700))))[node][rows]
                    p = stay * taken[rows] + (1 - stay) * p
            firsts = first
        place = class_contexts(keys[first]) * 256 + (1 << bit) + ((keys[first] & np.uint64(255)) >> np.uint64(8 - bit)).astype(np.int64)
        yield bit, place, inside, p


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers: how many, then their bytes by significance, compressed."""
    planes = b"".join((values >> values.dtype.type(8 * i)).astype(np.uint8).tobytes() for i in range(values.dtype.itemsize - 1, -1, -1))
    return len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = planes[0].astype(kind)
    for plane in planes[1:]:
        out <<= kind(8)
        out |= plane
    return out


def packed_text(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=6).compress(data, asbytes=True) if data else b"")


def unpacked_text(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], n, codec="zstd", asbytes=True) if n else b""


def ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


#: Turned grams have the nearest four bytes first, so that a bucket's are close together; straight() turns them back.
def straight(keys: np.ndarray) -> np.ndarray:
    near, far, byte = keys >> np.uint64(32), keys >> np.uint64(8) & np.uint64(0xFFFFFF), keys & np.uint64(255)
    return far << np.uint64(40) | near << np.uint64(8) | byte


def first_ones(ordered: np.ndarray) -> np.ndarray:
    """Whether each of ordered numbers differs from the one before."""
    return np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)]


def order_of(keys: np.ndarray) -> np.ndarray:
    """An ascending order of 64-bit keys, by their lower and then their upper halves, each sorted with its place behind it;
    plain sorts of numbers are several times faster than argsort."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    places = np.arange(len(keys), dtype=np.uint64)
    order = (np.sort(keys << half | places) & low).astype(np.int64)
    return order[(np.sort(keys[order] >> half << half | places) & low).astype(np.int64)]


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of ascending turned grams by bucket, ascending in each, and the bounds of the buckets in it."""
    near = keys >> np.uint64(32)
    heads = np.flatnonzero(first_ones(near))
    bucket = ((near[heads] * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    sizes, turn = np.diff(np.r_[heads, len(keys)]), np.argsort(bucket, kind="stable")
    after = np.cumsum(sizes[turn])
    order = np.repeat(heads[turn] - (after - sizes[turn]), sizes[turn]) + np.arange(len(keys))
    return order, np.r_[0, after][np.r_[0, np.cumsum(np.bincount(bucket, minlength=buckets))]]


def words_of(data: bytes) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """Of words with a space behind each: the distinct ones, the number of each word among them, and where each word ends."""
    stops = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(np.r_[0, stops]), pa.py_buffer(data)]).dictionary_encode()
    return words.dictionary, np.frombuffer(words.indices.buffers()[1], np.int32, len(words)), stops


def words_of_texts(text: bytes, lengths: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """Of joined normal texts: distinct words and the number of each word, as above, and where the words of each text begin.
    A text without words has the empty one."""
    words, at, stops = words_of(text.replace(END, b" "))
    return words, at, np.searchsorted(stops, np.cumsum(lengths) - lengths, side="right")


def words_by_bucket(words: pa.LargeBinaryArray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of distinct words by bucket, without the empty one, and the bounds of the buckets in it."""
    names = words.buffers()[2].to_pybytes().split(b" ")[:-1]  # several times faster than to_pylist
    bucket = np.fromiter((zlib.crc32(w) % buckets if w else buckets for w in names), np.int64, len(words))
    order = np.frombuffer(pc.sort_indices(words).buffers()[1], np.uint64, len(words)).astype(np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    bounds = np.r_[0, np.cumsum(np.bincount(bucket, minlength=buckets)[:buckets])]
    return order[: bounds[-1]], bounds


def blocks_of(docs: DataFrame, size: int = 1 << 23) -> DataFrame:
    """Documents in blocks, from columns key, text (binary), held_out: keys, held and lengths of a block's documents, and
    their normal texts, packed."""
    typed = pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), count()
        for keys, texts, held in parts_of(batches, size):
            whole = [b" ".join(normal(t)) + END for t in texts]
            row = {"block": task * (1 << 24) + next(number), "keys": keys, "held": held, "lengths": list(map(len, whole)), "text": packed_text(b"".join(whole))}
            yield pa.RecordBatch.from_pylist([row], schema=typed)

    return docs.mapInArrow(run, "block long, keys array<long>, held array<boolean>, lengths array<long>, text binary")


def whole_texts(lengths: np.ndarray, text: bytes) -> list[bytes]:
    return [text[e - n : e] for e, n in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True)]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, so that one block or bucket is held as Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def asked(blocks: DataFrame, buckets: int) -> DataFrame:
    """What blocks ask of buckets: grams and n, words and times, n and times being counts in training documents."""
    schema = "bucket int, block long, grams binary, n binary, words binary, times binary"
    typed = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("grams", "n", "words", "times")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            text, lengths, held = unpacked_text(row["text"]), np.array(row["lengths"], np.int64), np.array(row["held"], bool)
            keys, first, out = runs_of(whole_texts(lengths, text), held.astype(np.uint8))
            n = np.add.reduceat(1 - out, first, dtype=np.uint32)
            del first, out
            order, bounds = by_bucket(keys, buckets)
            keys, n = keys[order], n[order]
            del order
            words, at, begin = words_of_texts(text, lengths)
            times = np.bincount(at, np.repeat(~held, np.diff(np.r_[begin, len(at)])), len(words)).astype(np.uint64)
            order, ends = words_by_bucket(words, buckets)
            words, times, rows = words.take(pa.array(order)), times[order], []
            names, spans = words.buffers()[2].to_pybytes(), np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
            for bucket in range(buckets):
                a, b, c, d = *bounds[bucket : bucket + 2], *ends[bucket : bucket + 2]
                if a < b or c < d:
                    grams = np.diff(keys[a:b], prepend=np.uint64(0))
                    rows.append({"bucket": bucket, "block": row["block"], "grams": packed(grams), "n": packed(n[a:b]), "words": packed_text(names[spans[c] : spans[d]]), "times": packed(times[c:d])})
            yield pa.RecordBatch.from_pylist(rows, schema=typed)

    return blocks.select("block", "held", "lengths", "text").mapInArrow(run, schema)


def added_up(questions: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """A bucket's distinct grams, turned and ascending, their training counts, and the places of each question's grams among
    them; the training counts of its distinct words, and the places of each question's words among those."""
    keys, parts, waiting = np.zeros(0, np.uint64), [], 0
    for i, q in enumerate(questions):
        parts.append(ascending(q["grams"]))
        waiting += len(parts[-1])
        if waiting > max(len(keys), 1 << 21) or i + 1 == len(questions):
            found = np.concatenate([keys, *parts])
            parts, waiting = [], 0
            found.sort()
            keys = found[first_ones(found)]
    n, places = np.zeros(len(keys), np.int64), []
    for q in questions:
        places.append(np.searchsorted(keys, ascending(q["grams"])).astype(np.int32))
        n[places[-1]] += unpacked(q["n"], np.uint32)
    times = [unpacked(q["times"], np.uint64) for q in questions]
    words, at, _ = words_of(b"".join(unpacked_text(q["words"]) for q in questions))
    counts = np.bincount(at, np.concatenate(times), len(words)).astype(np.int64)
    return keys, n, places, counts, np.split(at, np.cumsum([len(x) for x in times])[:-1])


def in_order(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams = straight(keys)
    order = order_of(grams)
    return grams[order], n[order], order


def model_of(questions: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], int, int]:
    """Class contexts' part of the model: the cells that grams use, sorted, and their values. Also the distinct words of
    training and how many words it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys, n, _, counts, _ = added_up(row["questions"])
            totals = [int((counts > 0).sum()), int(counts.sum())]
            yield pa.RecordBatch.from_pydict({"cell": pa.array([-1, -2], pa.int32()), "n": pa.array(totals, pa.int64()), "deeper": pa.array([0.0, 0.0])})
            if not len(keys):
                continue
            grams, n, _ = in_order(keys, n)
            names, at = np.unique(class_contexts(grams), return_inverse=True)
            counts = np.bincount(at * 256 + (grams & np.uint64(255)).astype(np.int64), n)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"cell": pa.array((names[used // 256] * 256 + used % 256).astype(np.int32)), "n": pa.array(counts[used].astype(np.int64)), "deeper": pa.array(np.zeros(len(used)))})
            for _, place, inside, _ in decisions(grams, n, chances=False):
                cell, at = np.unique(place, return_inverse=True)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cell.astype(np.int32)), "n": pa.array(np.zeros(len(cell), np.int64)), "deeper": pa.array(np.bincount(at, inside, len(cell)))})

    found = questions.select("questions").mapInArrow(run, "cell int, n long, deeper double")
    found = found.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("deeper").alias("deeper")).toArrow()  # at most CELLS rows and two
    cell, n_of, below = (found.column(c).to_numpy() for c in ("cell", "n", "deeper"))
    distinct, total = (int(n_of[cell == i].sum()) for i in (-1, -2))
    counts, deeper, real = np.zeros(CELLS, np.int64), np.zeros(CELLS), cell >= 0
    counts[cell[real]], deeper[cell[real]] = n_of[real], below[real]
    used = np.unique(cell[real])
    return (used, weighted(counts, deeper)[used]), distinct, total


def answers_of(questions: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """For each block that asked a bucket: of its grams the log10 probabilities, negated, in 1 / STEPS; of its words the
    training counts."""
    sent = questions.sparkSession.sparkContext.broadcast(model)
    typed = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("logs", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, values = sent.value
        for row in rows_of(batches):
            keys, n, places, counts, words = added_up(row["questions"])
            steps = np.zeros(len(keys), np.uint32)
            if len(keys):
                grams, n, order = in_order(keys, n)
                context, byte, logs = class_contexts(grams) * 256, (grams & np.uint64(255)).astype(np.int64), np.zeros(len(grams))
                for bit, _, _, p in decisions(grams, n):
                    top, taken = values[np.searchsorted(cell, context + (1 << bit) + (byte >> (8 - bit)))], byte >> (7 - bit) & 1
                    logs += np.log10(np.where(taken == 1, top[:, 1], top[:, 0]) + top[:, 2].astype(np.float64) * p)
                steps[order] = np.rint(np.maximum(-logs, 0.0) * STEPS)
            for q, at, names in zip(row["questions"], places, words, strict=True):
                yield pa.RecordBatch.from_pylist([{"block": q["block"], "bucket": row["bucket"], "logs": packed(steps[at]), "counts": packed(counts[names].astype(np.uint64))}], schema=typed)

    return questions.mapInArrow(run, "block long, bucket int, logs binary, counts binary")


def sums_of(blocks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """key, held_out, n_tokens, known, base (sum of log10 (count + 1) of words), score of every document."""

    def run(block: pa.Table, answered: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        text, lengths, replies = unpacked_text(row["text"]), np.array(row["lengths"], np.int64), sorted(answered.to_pylist(), key=lambda a: a["bucket"])
        keys, first, number = runs_of(whole_texts(lengths, text), np.arange(len(lengths), dtype=np.int32))
        order, logs = by_bucket(keys, buckets)[0], np.empty(len(keys))
        logs[order] = np.concatenate([unpacked(a["logs"], np.uint32) for a in replies])
        logs = np.repeat(logs, np.diff(np.r_[first, len(number)]))
        score = np.bincount(number, logs, len(lengths)) / -STEPS  # sums of whole numbers
        del keys, first, number, order, logs
        words, at, begin = words_of_texts(text, lengths)
        order, counts = words_by_bucket(words, buckets)[0], np.zeros(len(words))  # the empty word stays at 0
        counts[order] = np.concatenate([unpacked(a["counts"], np.uint64) for a in replies])
        return pa.table({
            "key": pa.array(row["keys"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(np.diff(np.r_[begin, len(at)]) + (lengths > 1)),
            "known": pa.array(np.add.reduceat(counts[at] > 0, begin, dtype=np.int64)), "base": pa.array(np.add.reduceat(np.log10(counts + 1)[at], begin)), "score": pa.array(score)})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "key long, held_out boolean, n_tokens long, known long, base double, score double")


def scored(docs: DataFrame, held_out, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    cut = docs.select(F.col("doc_id").cast("long").alias("key"), F.col(text).cast("binary").alias("text"), held_out.alias("held_out"))
    size, ends = cut.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.when(~F.col("held_out"), 1))).first()
    buckets = max(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), size >> 23)
    blocks = shared.written(blocks_of(cut), "blocks", compression="uncompressed")
    with shared.shuffles_removed(cut.sparkSession):
        together = asked(blocks, buckets).repartition(buckets, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("block", "grams", "n", "words", "times")).alias("questions"))
        questions = shared.written(together, "questions", compression="uncompressed")
    model, distinct, words = model_of(questions)
    n, v = words + ends, distinct + (1 if ends else 0)
    below = float(n + v + 1)
    return sums_of(blocks, answers_of(questions, model), buckets).select(
        F.col("key").alias("doc_id"), "held_out", "n_tokens", (F.col("known") + (1 if ends else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.log10(F.lit(ends + 1.0)) - F.col("n_tokens") * F.log10(F.lit(below))).alias("base_score"), "score",
    )


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(shared.table(spark, sf_dir, "documents"), shared.fold("doc_id", 7) == 2)
