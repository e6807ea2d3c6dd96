"""Problem 10: texts over a size limit in pieces, by recursive bisection at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.tokens import encode, encoder, texts_of

#: Strength of a boundary: a place between characters only, words, sentences, lines, paragraphs.
NAMES = ["character", "word", "sentence", "line", "paragraph"]
_ENDS = [
    (2, re.compile(r"(?<=[.!?…])[\"'”’»)\]]*(?=\s)|[。！？](?=\S)")),
    (3, re.compile(r"[\n\r ](?=[^\n\r])")),
    (4, re.compile(r"\n[^\S\n]*\n\s*(?=\S)| ")),
]


#: Whether a code point is white space.
_SPACE = np.array([chr(i).isspace() for i in range(0x3001)])
_LENGTHS: dict[int, np.ndarray] = {}


def token_lengths(enc) -> np.ndarray:
    """Bytes of every token, listed once per worker."""
    if id(enc) not in _LENGTHS:
        lengths = np.zeros(enc.n_vocab, np.int64)
        for i in range(enc.n_vocab):
            try:
                lengths[i] = len(enc.decode_single_token_bytes(i))
            except KeyError:  # a free number
                continue
        _LENGTHS[id(enc)] = lengths
    return _LENGTHS[id(enc)]


def word_ends(text: str) -> np.ndarray:
    """The characters of white space that follow something else: the safe boundaries of tokens.parts."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _SPACE[np.minimum(points, len(_SPACE) - 1)] & (points < len(_SPACE))
    return np.flatnonzero(blank[1:] & ~blank[:-1]) + 1


def boundaries(text: str, ids: np.ndarray, enc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token but the first: the strength of the boundary before it, -1 if it begins inside a character. The
    character at which each token begins (of the last whole character before, if inside one). And the tokens that begin at
    the end of a word."""
    token_byte = np.r_[0, np.cumsum(token_lengths(enc)[ids])]
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte at which each character begins
    char_byte = np.r_[starts, len(raw)]
    at = np.searchsorted(char_byte, token_byte, side="right") - 1
    strength = np.where(char_byte[at] == token_byte, 0, -1)
    safe = np.empty(0, np.int64)
    for rank, ends in [(1, word_ends(text)), *((r, np.fromiter((m.end() for m in x.finditer(text)), np.int64)) for r, x in _ENDS)]:
        if len(ends):
            want = char_byte[ends]
            k = np.searchsorted(token_byte, want)
            hit = k[(k < len(token_byte)) & (token_byte[np.minimum(k, len(token_byte) - 1)] == want)]
            strength[hit] = np.maximum(strength[hit], rank)
            safe = hit if rank == 1 else safe
    return strength, at, safe


def bisect(strength: np.ndarray, n: int, fits: Callable[[int, int], bool]) -> list[int]:
    """Token positions at which to cut n tokens so that every stretch (lo, hi) between them fits.

    A stretch is cut at the strongest boundary of its middle half, nearest to the middle; without one of a word or more
    there, at the nearest such boundary anywhere; without any, at the character nearest to the middle.
    """
    cuts, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2 or fits(lo, hi):
            continue
        quarter, mid = (hi - lo) // 4, (lo + hi) // 2
        inner = np.arange(lo + max(1, quarter), hi - quarter + 1)
        inner = inner[inner < hi]
        own = strength[inner]
        best = own.max()
        if best < 1:
            inner = np.arange(lo + 1, hi)
            own = np.minimum(strength[inner], 1)
            best = own.max()
            if best < 0:
                continue  # one character of many tokens: nothing to cut
        places = inner[own == best]
        at = int(places[np.argmin(np.abs(places - mid))])
        cuts.append(at)
        todo += [(lo, at), (at, hi)]
    return sorted(cuts)


def split_text(text: str, enc, most: int, overlap: int) -> list[tuple[str, int, int, int, str]]:
    """(piece, tokens, tokens of overlap, characters of overlap, boundary at its core's start) of a text over ``most`` tokens.

    Cores join to the text. Each piece but the first begins with the ``overlap`` tokens before its core, up to 3 less where
    they would begin inside a character. Pieces are counted as texts of their own, overlap included; a core whose piece is
    over ``most`` is bisected further. Only where a core of ``overlap`` tokens or less is still over it, the overlap is shortened.
    """
    ids = encode(text, enc)
    if len(ids) <= most:
        return [(text, len(ids), 0, 0, "start")]
    strength, char, safe = boundaries(text, ids, enc)

    def begin(lo: int, at: int) -> int:
        while at < lo and strength[at] < 0:
            at += 1
        return at

    known: dict[tuple[int, int], int] = {}

    def tokens_in(start: int, hi: int) -> int:
        return len(encode(text[char[start] : char[hi]], enc)) if start < hi else 0

    def counted(start: int, hi: int) -> int:
        """The tokens of a piece as a text of its own: between two safe boundaries they are those of the whole text."""
        if (start, hi) not in known:
            i, j = np.searchsorted(safe, start), np.searchsorted(safe, hi, side="right") - 1
            inner = i < j
            known[start, hi] = tokens_in(start, safe[i]) + int(safe[j] - safe[i]) + tokens_in(safe[j], hi) if inner else tokens_in(start, hi)
        return known[start, hi]

    def fits(lo: int, hi: int) -> bool:
        if hi - lo > most - overlap:
            return False
        return hi - lo <= max(overlap, 1) or counted(begin(lo, max(0, lo - overlap)), hi) <= most

    cuts = [0, *bisect(strength, len(ids), fits), len(ids)]
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        start = begin(lo, max(0, lo - overlap))
        while (count := counted(start, hi)) > most and start < lo:
            start = begin(lo, start + 1)
        out.append((text[char[start] : char[hi]], count, lo - start, int(char[lo] - char[start]), NAMES[max(0, strength[lo])] if lo else "start"))
    return out


def split_corpus(docs: DataFrame, doc_id: str, text: str, tokenizer: str, most: int, overlap: int) -> DataFrame:
    """doc_id, piece_no (from 1), n_tokens, overlap_tokens, overlap_chars, cut_at, piece: of every text of more than ``most`` tokens.

    Without their overlap_chars the pieces join to the text. Texts within the limit, null and empty ones have no rows.
    A piece that nothing can cut (one character of more tokens than ``most``) stays over it, with its tokens counted.
    Repeated rows are split as often as they stand; other columns aren't read. No shuffle.
    """
    if not 0 <= overlap < most:
        raise ValueError("overlap must be less than the limit")
    names = ["doc_id", "piece_no", "n_tokens", "overlap_tokens", "overlap_chars", "cut_at", "piece"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                rows = []
                for d, t in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                    if len(t.encode("utf-8", "replace")) <= most:
                        continue  # a token has a byte at least
                    pieces = split_text(t, enc, most, overlap)
                    if pieces[0][1] > most or len(pieces) > 1:
                        rows += [(d, k, n, o, oc, at, p) for k, (p, n, o, oc, at) in enumerate(pieces, 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        run, "doc_id bigint, piece_no int, n_tokens int, overlap_tokens int, overlap_chars int, cut_at string, piece string"
    )
