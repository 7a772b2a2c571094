"""BPE encoding and decoding with tree concatenation.

A text over LEAF_BYTES is halved until its leaves are no longer. The leaves of many texts are encoded
in one parallel batch; then halves are joined level by level: a window around the cut, a few chunks
(runs without white space) to either side, is encoded anew by the tokenizers library, and grows until
the ids of its outermost chunks equal those that both sides hold for them.

White space never enters a token of the word-based vocabularies used here, so chunks encode on their
own, and agreement on a chunk proves the seam there. Chunks repeat, so each worker remembers the ids of
those it has seen. No cut lies in a chunk over UNSPLIT_BYTES: such a chunk is encoded by the same
method on the symbols of its unsplit pieces, with windows of tokens.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioflow.llm.common import free_name, trimmed

#: Longer texts are encoded by tree concatenation; its leaves have at most so many bytes.
LEAF_BYTES = 2048
#: Chunks over so many bytes have a tree of their own, whose leaves have at most so many symbols.
UNSPLIT_BYTES = 4096
LEAF_SYMBOLS = 1024
#: Bytes of chunks, and of pieces of letters and signs, at which a worker begins a new memo; it holds the one before, too.
CHUNK_BYTES, PIECE_BYTES = 40 << 20, 32 << 20
#: The share of that where texts are decoded as well, which takes memory of its own.
SHARE = 0.4
#: What an entry takes beside its ids.
ENTRY_BYTES = 200
#: New chunks are encoded so many at a time, because the library's results take much memory.
BATCH_CHUNKS = 4096
#: Latin letters (all of them precomposed), then ASCII signs that start neither a contraction nor a special token.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=-@\[-`{-~]*)")
PLAIN_ASCII = re.compile(rb"([A-Za-z]*)([!-&(-/:;=-@\[-`{-~]*)")
#: The splitting pattern of the vocabularies for which plain chunks are put together from letters and signs (a fixed value).
WORDS_AND_SIGNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = re.compile(rb"[\t-\r ]")
#: What a byte is to ``pieces``: white space, a letter of plain chunks, a sign of these, or else.
BLANK, LETTER, SIGN, OTHER = range(4)
KINDS = np.array([BLANK if SPACE.match(bytes([b])) else LETTER if PLAIN_ASCII.fullmatch(bytes([b, b"!"[0]])) and chr(b).isalpha() else SIGN if PLAIN_ASCII.fullmatch(bytes([b])) else OTHER for b in range(256)], dtype=np.uint8)
#: Texts are handled in slices of about so many bytes.
SLICE_BYTES = 4 << 20


@lru_cache(maxsize=1)
def symbols_by_byte() -> dict[int, str]:
    """The symbol that stands for each byte that does not stand for itself: bytes without a visible Latin-1 character have those from 256 on, in order."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def symbol_points() -> np.ndarray:
    """The code point of each byte's symbol; the space stands for itself."""
    out = np.arange(256, dtype="<u4")
    for b, symbol in symbols_by_byte().items():
        out[b] = ord(symbol)
    out[32] = 32
    return out


class Memo(dict):
    """Ids by bytes or text. What has not been asked for while the memo filled up twice is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held, self.old = most, 0, {}

    def keep(self, pairs: list[tuple]) -> None:
        self.held += ENTRY_BYTES * len(pairs) + sum([len(v) for _, v in pairs])
        self.update(pairs)

    def missing(self, wanted: set | list) -> set:
        """What is neither held nor found among what was held before, which is held again."""
        fresh = {k for k in wanted if k not in self}  # the methods of sets would walk the whole memo
        if old := self.old:
            again = [k for k in fresh if k in old]
            self.keep([(k, old[k]) for k in again])
            fresh.difference_update(again)
        return fresh

    def trim(self) -> None:
        if self.held > self.most:
            self.old, self.held = dict(self), 0
            self.clear()


class Node:
    """A stretch of a text: its chunks and their ids, and whether a chunk goes on beyond its end."""

    __slots__ = ("ids", "open", "words")

    def __init__(self, words: list[bytes], ids: list[bytes], going_on: bool):
        self.words, self.ids, self.open = words, ids, going_on


class Encoder:
    """The ids of texts as the tokenizers library gives them without special tokens added."""

    def __init__(self, path: str, share: float = 1.0):
        # a task has one core, and Spark runs as many tasks as there are cores
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model_only = Tokenizer(self.tokenizer.model)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.shown = [t.encode() for t in self.tokens]
        self.ends = self.tokenizer.model.end_of_word_suffix or ""
        self.lengths = [len(t.removesuffix(self.ends)) if self.ends else len(t) for t in self.tokens]
        self.by_space = Tokenizer(self.tokenizer.model)
        self.by_space.pre_tokenizer = WhitespaceSplit()
        self.last = np.array([bool(self.ends) and t.endswith(self.ends) for t in self.tokens])
        self.chunks, self.pieces = Memo(int(share * CHUNK_BYTES)), Memo(int(share * PIECE_BYTES))
        self.splits_plainly = self.letters_and_signs()
        self.joins = 0

    def letters_and_signs(self) -> bool:
        """Whether the vocabulary's own steps split plain chunks into lower-case letters and signs, as ``learn`` does."""
        told = json.loads(self.tokenizer.to_str())
        steps = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        normal = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        return normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"].get("Regex") == WORDS_AND_SIGNS and bool(self.ends)

    def piece_ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces without white space, each of which ends with an end-of-word token."""
        symbols = symbol_points()[np.frombuffer(b" ".join(pieces), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.by_space.encode_batch_fast([symbols], add_special_tokens=False)[0].ids, dtype="<u4")  # without offsets
        ends = np.append(0, np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) != len(pieces) + 1 or ends[-1] != 4 * len(ids):
            raise ValueError("the vocabulary does not end each word by a token with its suffix")
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def learn(self, texts: list[list[bytes]]) -> None:
        """Remember the ids of the chunks not seen before; plain ones are put together from their letters and signs."""
        self.chunks.trim()
        self.pieces.trim()
        fresh = [w for w in self.chunks.missing(set().union(*texts)) if len(w) <= UNSPLIT_BYTES]
        if self.splits_plainly:
            rest, plain, ascii_match, match = [], [], PLAIN_ASCII.fullmatch, PLAIN.fullmatch
            for w in fresh:
                if found := ascii_match(w):
                    letters, signs = found.groups()
                    plain.append((w, letters.lower(), signs))
                elif found := match(w.decode("utf-8", "replace")):
                    plain.append((w, found[1].lower().encode(), found[2].encode()))
                else:
                    rest.append(w)
            wanted = {letters for _, letters, _ in plain} | {signs for *_, signs in plain}
            wanted.discard(b"")
            ordered = list(self.pieces.missing(wanted))
            for at in range(0, len(ordered), BATCH_CHUNKS):
                some = ordered[at : at + BATCH_CHUNKS]
                self.pieces.keep(list(zip(some, self.piece_ids(some), strict=True)))
            ids_of = self.pieces.get
            self.chunks.keep([(w, ids_of(letters, b"") + ids_of(signs, b"")) for w, letters, signs in plain])
            fresh = rest
        for at in range(0, len(fresh), BATCH_CHUNKS):
            words = fresh[at : at + BATCH_CHUNKS]
            self.chunks.keep(list(zip(words, self.whole(words), strict=True)))

    def whole(self, texts: list[bytes]) -> list[bytes]:
        """The library's ids of each text."""
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        try:
            return list(map(self.chunks.__getitem__, words))
        except KeyError:  # a long one among them
            return [self.chunks[w] if w in self.chunks else self.unsplit(w) for w in words]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The texts' ids as little-endian unsigned 32-bit integers."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here has cycles, and the memo is large to walk
        try:
            return self.encoded(texts)
        finally:
            if collecting:
                gc.enable()

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        bounds = [self.cuts(t) for t in texts]
        leaves = [[t[a:b].split() for a, b in zip(ends, ends[1:], strict=False)] for t, ends in zip(texts, bounds, strict=True)]
        self.learn([words for each in leaves for words in each])
        trees = []
        for text, ends, each in zip(texts, bounds, leaves, strict=True):
            trees.append([Node(words, self.ids_of(words), end < len(text) and not text[end - 1 : end].isspace() and not text[end : end + 1].isspace()) for words, end in zip(each, ends[1:], strict=True)])
        while any(len(nodes) > 1 for nodes in trees):
            pairs = [(nodes[i], nodes[i + 1]) for nodes in trees for i in range(0, len(nodes) - 1, 2)]
            joined = iter(self.concatenated(pairs))
            trees = [[next(joined) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)] for nodes in trees]
        return [b"".join(nodes[0].ids) if nodes else b"" for nodes in trees]

    def flat_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts that ``data`` holds one after another, and where each text begins and ends in them.

        Chunks encode on their own, so each distinct piece of the texts is looked up once and its ids are laid out wherever it comes.
        """
        column, odd, first = pieces(data, offsets, self.splits_plainly)
        if not len(column):
            return np.zeros(0, dtype="<u4"), np.zeros(len(offsets), dtype=np.int64)
        held = column.dictionary_encode()
        _, bounds, flat = held.dictionary.buffers()
        bounds, flat = np.frombuffer(bounds, np.int32)[: len(held.dictionary) + 1].tolist(), flat.to_pybytes()
        words, at = [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], held.indices.to_numpy()
        whole = np.zeros(len(words), dtype=bool)
        whole[at] = odd
        chunks = list(compress(words, whole.tolist()))
        self.learn([chunks])
        known = dict(zip(chunks, self.ids_of(chunks), strict=True))
        fresh = list(self.pieces.missing(list(compress(words, (~whole).tolist()))))
        for k in range(0, len(fresh), BATCH_CHUNKS):
            some = fresh[k : k + BATCH_CHUNKS]
            self.pieces.keep(list(zip(some, self.piece_ids(some), strict=True)))
        ids_of = self.pieces.get
        found = [known[w] if o else ids_of(w) for w, o in zip(words, whole.tolist(), strict=True)]
        sizes = np.array([len(f) // 4 for f in found], dtype=np.int64)
        each = sizes[at]
        ends = np.append(0, np.cumsum(each))
        places = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], each) + np.arange(ends[-1])
        return np.frombuffer(b"".join(found), "<u4")[places], ends[first]

    def cuts(self, text: bytes) -> list[int]:
        """Where a text's leaves begin and end: halves of halves, moved to the beginning of a symbol, none in a long chunk."""
        n = len(text)
        parts = 1
        while parts * LEAF_BYTES < n:
            parts *= 2
        ends, beyond = [0], 0
        for i in range(1, parts):
            at = n * i // parts
            while at < n and text[at] & 0xC0 == 0x80:
                at += 1
            if at <= beyond:  # in a long chunk
                continue
            start = max(text.rfind(s, max(0, at - UNSPLIT_BYTES), at) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
            after = SPACE.search(text, at, at + UNSPLIT_BYTES)
            if (start or at < UNSPLIT_BYTES) and (after or n - at < UNSPLIT_BYTES) and (after.start() if after else n) - start <= UNSPLIT_BYTES:
                if at > ends[-1]:
                    ends.append(at)
                continue
            after = SPACE.search(text, at)
            at = beyond = after.start() if after else n
            if ends[-1] < at < n:
                ends.append(at)
        return [*ends, n] if n else [0]

    def concatenated(self, pairs: list[tuple[Node, Node]]) -> list[Node]:
        """Each pair of neighbours as one node, by windows around the cut that grow until both sides agree."""
        out: list[Node | None] = [None] * len(pairs)
        waiting, k = range(len(pairs)), 2
        while waiting:
            windows = [b" ".join(a.words[-k:]) + (b"" if a.open else b" ") + b" ".join(b.words[:k]) for a, b in (pairs[i] for i in waiting)]
            left = []
            for i, window, ids in zip(waiting, windows, self.whole(windows), strict=True):
                a, b = pairs[i]
                first, last = len(a.words) > k, len(b.words) > k  # beyond an end of both there is nothing to agree on
                head = a.ids[-k] if first else b""
                tail = b.ids[k - 1] if last else b""
                if len(ids) < len(head) + len(tail) or not ids.startswith(head) or not ids.endswith(tail):
                    left.append(i)
                    continue
                # the window between the chunks that agree is one run of whole chunks from now on
                middle = window[len(a.words[-k]) if first else 0 : len(window) - (len(b.words[k - 1]) if last else 0)]
                keep_a, keep_b = (len(a.words) - k + 1 if first else 0), (k - 1 if last else len(b.words))
                out[i] = Node([*a.words[:keep_a], middle, *b.words[keep_b:]], [*a.ids[:keep_a], ids[len(head) : len(ids) - len(tail)], *b.ids[keep_b:]], b.open)
                self.joins += 1
            waiting, k = left, 2 * k
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of some ids, special tokens included; without a decoder in the vocabulary, that is its tokens joined by spaces."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(memoryview(ids).cast("I").tolist(), skip_special_tokens=False).encode()
        return b" ".join(map(self.shown.__getitem__, memoryview(ids).cast("I")))

    def unsplit(self, chunk: bytes) -> bytes:
        """A long chunk without white space."""
        ids: list[int] = []
        text = chunk.decode("utf-8", "replace")
        for k, part in enumerate(self.added.split(text) if self.added else [text]):
            if k % 2:
                ids.append(self.tokenizer.token_to_id(part))
                continue
            normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if self.tokenizer.pre_tokenizer else [(normal, None)]
            short = iter(self.model_only.encode_batch_fast([p for p, _ in pieces if len(p) <= LEAF_SYMBOLS], add_special_tokens=False))
            for piece, _ in pieces:
                ids += next(short).ids if len(piece) <= LEAF_SYMBOLS else self.tree(piece)
        return array("I", ids).tobytes()

    def tree(self, symbols: str, leaf: int = LEAF_SYMBOLS) -> list[int]:
        """The ids of one unsplit piece: leaves in one parallel batch, then joins level by level.

        Every node holds the ids of its stretch taken as a whole piece. Two neighbouring tokens of a
        correct encoding stay correct neighbours anywhere, so a token that the window shares with a
        side proves the seam there.
        """
        ends = [0, len(symbols)]
        while max(b - a for a, b in zip(ends, ends[1:], strict=False)) > leaf:
            ends = sorted({*ends, *((a + b) // 2 for a, b in zip(ends, ends[1:], strict=False) if b - a > leaf)})
        spans = list(zip(ends, ends[1:], strict=False))
        found = self.model_only.encode_batch_fast([symbols[a:b] for a, b in spans], add_special_tokens=False)
        nodes = [(a, b, e.ids) for (a, b), e in zip(spans, found, strict=True)]
        while len(nodes) > 1:
            pairs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
            nodes = [p[0] if len(p) == 1 else (p[0][0], p[1][1], self.joined(symbols, *p)) for p in pairs]
        return nodes[0][2]

    def joined(self, symbols: str, left: tuple, right: tuple) -> list[int]:
        (lo, cut, a), (_, hi, b) = left, right
        k = 4
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            start = cut - sum(self.lengths[t] for t in a[i:])
            stop = cut + sum(self.lengths[t] for t in b[:j])
            window = self.model_only.encode(symbols[start:stop], add_special_tokens=False).ids
            if start == lo:
                i, from_left = 0, True
            else:
                from_left = window[0] == a[i] and len(window) > 2
            if stop == hi:
                kept, from_right = window, True
            else:  # the last token carries the end mark of a cut piece; the one before it must be the right side's
                from_right = len(window) > 2 and self.lengths[window[-1]] == self.lengths[b[j - 1]] and window[-2] == b[j - 2]
                kept = [*window[:-1], *b[j - 1 :]]
            if from_left and from_right:
                return [*a[:i], *kept]
            k *= 2


def pieces(data: np.ndarray, offsets: np.ndarray, plainly: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The pieces of texts, which of them are whole chunks, and the place of each text's first piece.

    Plain chunks are parted into lower-case letters and signs, if ``plainly``; others stay as they are.
    """
    kind, lowered = KINDS[data], data.copy()
    new = np.zeros(len(data) + 1, dtype=bool)
    new[offsets] = True  # a text begins
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    latin = (second & 0xC0 == 0x80) & (second != 0x97) & (second != 0xB7) & ~new[lead + 1]
    kind[lead[latin]] = kind[lead[latin] + 1] = LETTER
    lowered[(data >= 65) & (data <= 90)] += np.uint8(32)
    lowered[lead[latin & (second <= 0x9E)] + 1] += np.uint8(32)
    word = kind != BLANK
    begins = word.copy()
    begins[1:] &= ~word[:-1] | new[1:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return pa.array([], pa.binary()), starts, np.zeros(len(offsets), dtype=np.int64)
    before = np.append(np.uint8(BLANK), kind[:-1])
    odd = np.maximum.reduceat((kind == OTHER) | ((kind == LETTER) & (before == SIGN) & ~begins), starts)
    placed = np.append(0, np.cumsum(word))
    odd |= np.diff(placed[np.append(starts, len(data))]) > UNSPLIT_BYTES
    if not plainly:
        odd[:] = True
    within = np.append(np.zeros(starts[0], dtype=bool), np.repeat(odd, np.diff(np.append(starts, len(data)))))
    begins |= (kind == SIGN) & (before == LETTER) & ~within
    at = np.flatnonzero(begins)
    ends = np.append(placed[at], placed[-1]).astype(np.int32)
    flat = np.where(within, data, lowered)[word]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(flat)]), within[at], np.searchsorted(at, offsets)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The values of a binary column in lists of about ``limit`` bytes; nulls come as empty texts."""
    held, size = [], 0
    for value in column:
        held.append(value.as_py() or b"")
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


@lru_cache(maxsize=2)
def encoder_of(path: str, share: float = 1.0) -> Encoder:
    """One encoder for all tasks of a worker process, with a share of the memo's largest size."""
    return Encoder(path, share)


def bpe_encode_decode(
    docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded", columns: list[str] | None = None
) -> DataFrame:
    """Add each whole text's token ids (``array<int>``) and the text that they decode to.

    Null texts count as empty: an empty array and an empty string. Every row is handled by itself, so
    repeated rows give repeated results and an empty table an empty one. The other columns (or those
    named in ``columns``) pass through; columns already named like the two new ones are replaced. Rows
    travel in Arrow batches and are encoded in slices of bounded size; a text's memory is in
    proportion to its length.
    """
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in (ids.lower(), decoded.lower())]
    work = free_name(docs, "bpe_text")
    own = text in kept and isinstance(docs.schema[text].dataType, StringType)  # then the text need not travel twice
    extra = [] if own else [F.col(f"`{text}`").cast("string").cast("binary").alias(work)]
    staged = docs.select(*(F.col(f"`{c}`") for c in kept), *extra)
    place = kept.index(text) if own else len(kept)
    schema = docs.select(*(F.col(f"`{c}`") for c in kept), F.array(F.lit(0)).alias(ids), F.lit("").alias(decoded)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary, SHARE)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(place).cast(pa.binary())):
                found = encoder.encode(texts)
                bounds = np.zeros(len(found) + 1, dtype=np.int32)
                np.cumsum([len(f) // 4 for f in found], out=bounds[1:])
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
                shown = pa.array([encoder.decode(f) for f in found], type=pa.binary()).cast(pa.string())
                part = [batch.column(i).slice(at, len(found)) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*part, lists, shown], names=[*kept, ids, decoded])
                at += len(found)

    return staged.mapInArrow(trimmed(run), schema)
