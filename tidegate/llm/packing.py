"""Best-fit packing of documents into token sequences of one capacity, by large-item matching.

Only the histogram of piece lengths, at most ``capacity`` numbers, is ever solved in one place:
pieces above a third of the capacity meet at most twice per sequence, the largest with the
largest that fits; smaller ones, in falling size, go to the tightest gap that holds them. The
solution is a list of slots (a length, a range of ranks within it, where they go), and every
piece finds its slot by its rank among the pieces of its length. Ranks come from counts per
(length, bucket), so a length that a third of all pieces share is split over many tasks.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import insort
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import col
from ..session import cut
from .common import each_batch, small_batches, texts_as_bytes
from .tokencount import TokenizerSpec

#: Pieces of one length and bucket that a window brings together, on average.
BUCKET_ROWS = 1000
#: Distinct words whose ids a worker remembers at most before it forgets all of them.
MEMO = 700_000

#: Bytes of text whose words a worker holds at a time, if there is more than one text.
CHUNK = 4 << 20
#: Punctuation that may be taken off the end of a word.
ENDS = b".,;:!?*&$#%)]}\"-"
#: Letters up to U+00FF that normalisation leaves as they are.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_RUN = re.compile(f"[{LETTERS}]+")

_MEMO: dict[tuple[str, str], dict[bytes, bytes]] = {}
_ALPHABETS: dict[tuple[str, str], dict[int, str] | None] = {}


@dataclass(frozen=True)
class Slot:
    """Ranks [rank, rank + n) of a length: ``each`` of them, one behind the other, per sequence."""

    length: int
    rank: int
    n: int
    sequence: int
    offset: int
    each: int


class _Gaps:
    """Open sequences by free room: ranges of sequence numbers."""

    def __init__(self) -> None:
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if not self.ranges[room]:
                insort(self.rooms, room)
            self.ranges[room].append((first, n))

    def tightest(self, size: int) -> int | None:
        i = int(np.searchsorted(self.rooms, size)) if self.rooms else 0
        return self.rooms[i] if i < len(self.rooms) else None

    def take(self, room: int) -> tuple[int, int]:
        found = self.ranges[room].pop()
        if not self.ranges[room]:
            self.rooms.remove(room)
        return found


def solve(counts: dict[int, int], capacity: int) -> list[Slot]:
    """Slots for a histogram of lengths in 1 ... capacity; every rank gets exactly one."""
    left, used, slots, gaps, fresh = dict(counts), defaultdict(int), [], _Gaps(), 0

    def place(size: int, n: int, sequence: int, offset: int, each: int) -> None:
        slots.append(Slot(size, used[size], n, sequence, offset, each))
        used[size] += n
        left[size] -= n

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for size in large:
        while left[size]:
            fits = [s for s in large if s <= size and s <= capacity - size and left[s]]
            mate = fits[0] if fits else None
            if mate is None:
                n = left[size]
                place(size, n, fresh, 0, 1)
                gaps.add(capacity - size, fresh, n)
            elif mate == size:
                n, odd = divmod(left[size], 2)
                if n:
                    place(size, 2 * n, fresh, 0, 2)
                    gaps.add(capacity - 2 * size, fresh, n)
                elif odd:  # the last one of its size looks for a smaller mate
                    smaller = [s for s in fits if s != size]
                    n = 1
                    place(size, 1, fresh, 0, 1)
                    if smaller:
                        place(smaller[0], 1, fresh, size, 1)
                    gaps.add(capacity - size - (smaller[0] if smaller else 0), fresh, 1)
            else:
                n = min(left[size], left[mate])
                place(size, n, fresh, 0, 1)
                place(mate, n, fresh, size, 1)
                gaps.add(capacity - size - mate, fresh, n)
            fresh += n

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            room = gaps.tightest(size)
            if room is None:
                room, first, n = capacity, fresh, -(-left[size] // (capacity // size))
                fresh += n
            else:
                first, n = gaps.take(room)
            each = room // size
            full = min(n, left[size] // each)
            if full:
                place(size, full * each, first, capacity - room, each)
                gaps.add(room - each * size, first, full)
            rest, first, n = min(left[size], each), first + full, n - full
            if n and rest and rest < each:  # the last few of this size share one sequence
                place(size, rest, first, capacity - room, rest)
                gaps.add(room - rest * size, first, 1)
                first, n = first + 1, n - 1
            gaps.add(room, first, n)
    return slots


def plain(word: bytes) -> tuple[bytes, bytes]:
    """A word that gives the same ids, and the punctuation behind it, which is a token run of its own.

    Only changes that these tokenizers undo anyway: case of letters up to U+00FF, and a run of
    ASCII punctuation (no apostrophes, nothing that special tokens are made of) after a letter or
    digit of that range, which always ends a run of letters or digits.
    """
    body = word.rstrip(ENDS)
    if len(body) < len(word) and not (body[-1:].isalnum() or (body[-2:-1] == b"\xc3" and body[-1:] not in b"\x97\xb7")):
        body = word
    end = word[len(body) :]
    if b"<" not in body:
        if body.isascii():
            body = body.lower()
        else:
            text = body.decode("utf-8", "replace")
            if max(text) < "\u0100":
                body = text.lower().encode()
    return body, end


def letter_alphabet(tokenizer: TokenizerSpec) -> dict[int, str] | None:
    """What the library's model gets for each of ``LETTERS``; None where a run of them is no single word to it.

    Such a run passes normalisation and pre-tokenisation as it is, letter by letter, so that the
    model alone gives its ids, at a third of the time.
    """
    key = (tokenizer.kind, tokenizer.path)
    if key not in _ALPHABETS:
        library, table = tokenizer.load(), None
        if tokenizer.kind == "tokenizers" and library.pre_tokenizer is not None:
            table = {ord(c): "".join(part for part, _ in library.pre_tokenizer.pre_tokenize_str(c)) for c in LETTERS}
            for run in (LETTERS, LETTERS[::-1], *LETTERS):
                whole = library.normalizer.normalize_str(run) if library.normalizer else run
                parts = [part for part, _ in library.pre_tokenizer.pre_tokenize_str(whole)]
                if parts != [run.translate(table)] or tokenizer.ids(run) != [t.id for t in library.model.tokenize(parts[0])]:
                    table = None
                    break
        _ALPHABETS[key] = table
    return _ALPHABETS[key]


def encode_words(words: list[bytes], tokenizer: TokenizerSpec) -> list[bytes]:
    """Ids of each word by the library: runs of letters by its model, others many per call with a special token between.

    The library takes such a token out before anything else and encodes what lies between on its
    own; words that hold a part of one are encoded by themselves.
    """
    library, table = tokenizer.load(), letter_alphabet(tokenizer)
    out: dict[bytes, bytes] = {}
    if table:
        model = library.model
        for word in words:
            text = word.decode("utf-8", "replace")
            if word.isalpha() and word.islower() or _RUN.fullmatch(text):
                ids = [t.id for t in model.tokenize(text if len(text) == len(word) else text.translate(table))]
                out[word] = struct.pack(f"<{len(ids)}I", *ids)
    special = [(i, t.content) for i, t in library.get_added_tokens_decoder().items() if t.special and not t.normalized]
    if special:
        number, mark = special[0]
        safe = [w for w in words if w not in out and mark[0].encode() not in w and mark[-1].encode() not in w]
        for start in range(0, len(safe), 1000):
            part = safe[start : start + 1000]
            text = mark.join([w.decode("utf-8", "replace") for w in part])
            ids = np.asarray(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.r_[np.flatnonzero(ids == number), len(ids)]
            begins = np.r_[0, ends[:-1] + 1]
            out.update((w, ids[a:b].tobytes()) for w, a, b in zip(part, begins, ends))
    for word in words:
        if word not in out:
            out[word] = np.asarray(tokenizer.ids(word.decode("utf-8", "replace")), "<u4").tobytes()
    return [out[w] for w in words]


def token_bytes(texts: list[bytes], tokenizer: TokenizerSpec) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of whole texts, word by word with a memory of words.

    The tokenizers in use drop white space before they look at words, so that ids of a text are
    the ids of its words between ASCII white space, one after the other; the library itself
    encodes each distinct word. ``tests/llm`` holds this against whole-text encoding.
    """
    if len(texts) > 1 and sum(map(len, texts)) > CHUNK:  # words of a few texts are held at a time
        half = len(texts) // 2
        return token_bytes(texts[:half], tokenizer) + token_bytes(texts[half:], tokenizer)
    split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
    found = split.flatten().dictionary_encode()
    ids = word_ids(found.dictionary.view(pa.binary()).to_pylist(), tokenizer)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat, begins = np.frombuffer(b"".join(ids) or bytes(4), "<u4"), np.cumsum(sizes) - sizes
    code = found.indices.to_numpy()
    each = sizes[code]
    ends = np.r_[0, np.cumsum(each)]
    taken = flat[np.repeat(begins[code] - ends[:-1], each) + np.arange(ends[-1])]
    bounds = ends[split.offsets.to_numpy()]
    return [taken[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]


def word_ids(words: list[bytes], tokenizer: TokenizerSpec) -> list[bytes]:
    """Ids of different words, remembered by the worker; an empty one has none."""
    known = _MEMO.setdefault((tokenizer.kind, tokenizer.path), {})
    out = [known.get(w) for w in words]
    lost = [i for i, ids in enumerate(out) if ids is None and words[i]]
    if len(known) + len(lost) > MEMO:
        known.clear()
    parts = [plain(words[i]) for i in lost]
    fresh = {part for pair in parts for part in pair if part and part not in known}
    known.update(zip(fresh, encode_words(list(fresh), tokenizer)))
    for i, (body, end) in zip(lost, parts):
        out[i] = known[body] + known[end] if end else known[body]
        if body not in fresh:  # a spelling is remembered from its second time on; most rare words come once
            known[words[i]] = out[i]
    return [ids or b"" for ids in out]


def cut_pieces(
    df: DataFrame, ident: str, text: str, tokenizer: TokenizerSpec, capacity: int = 4096, end: int = 1
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the CRC-32 of its ids.

    A document is its ids and then ``end``; only one that is longer than ``capacity`` is cut.
    A null or empty text is the end id alone.
    """
    tail = np.asarray([end], "<u4").tobytes()

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        idents, rows, which, starts, lengths, sums = batch.column("doc_id"), [], [], [], [], []
        for row, ids in enumerate(token_bytes(texts_as_bytes(batch.column("body")), tokenizer)):
            ids += tail
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append(row)
                which.append(piece)
                starts.append(at // 4)
                lengths.append(len(part) // 4)
                sums.append(zlib.crc32(part))
        return pa.RecordBatch.from_arrays(
            [
                idents.take(pa.array(rows, pa.int64())),
                pa.array(which, pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()),
            ],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    small_batches(df.sparkSession)
    kind = df.schema[ident].dataType.simpleString()
    source = df.select(col(ident).alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("body"))
    return source.mapInArrow(
        each_batch(pieces),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long",
    )


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (from ``cut_pieces``) with sequence_id and offset.

    Ties and repeated rows are interchangeable pieces; each gets a place of its own. An empty
    table stays empty. The ranks are drawn from a written copy, so that a repeated task finds
    the same ones.
    """
    spark = pieces.sparkSession
    stored = cut(pieces)
    counted = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = sorted(solve(counted, capacity), key=lambda s: (s.length, s.rank))

    # One row per length, at most ``capacity`` of them.
    shares = spark.createDataFrame([(k, n // BUCKET_ROWS + 1) for k, n in counted.items()], "length long, buckets long")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), "buckets").alias("bucket")
    dealt = stored.join(F.broadcast(shares), "length").select(*stored.columns, bucket)
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select(
        "length",
        "bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"),
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("nth", F.row_number().over(within) - 1)
        .join(before, ["length", "bucket"])
        .select(*stored.columns, (F.col("before") + F.col("nth")).cast("long").alias("rank"))
    )
    # At most a few slots per length: their number is bounded by the capacity, not by the data.
    table = {
        name: np.asarray([getattr(s, name) for s in slots], np.int64)
        for name in ("length", "rank", "sequence", "offset", "each")
    }
    starts = table["length"] * (1 << 48) + table["rank"]
    shared = spark.sparkContext.broadcast((starts, table))

    def seat(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, slot = shared.value
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        at = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
        nth = rank - slot["rank"][at]
        each = slot["each"][at]
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        columns += [
            pa.array(slot["sequence"][at] + nth // each),
            pa.array(slot["offset"][at] + nth % each * length),
        ]
        return pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema.fields)
    return ranked.mapInArrow(each_batch(seat), f"{schema}, sequence_id long, offset long")
