"""Whole-text encoding with a public BPE tokenizer, a column of texts at a time.

The tokenizer's own pipeline never lets a token cross ASCII white space and drops white space,
so the ids of a text are the ids of its white-space chunks, one after the other. Each distinct
piece is encoded once by the library and kept. Texts of Latin-1 characters, which composition
leaves as they are, are cut further, at the tokenizer's own word pattern; the others into
chunks. Texts that may hold a special token's string go to the library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import binaries, buffers, ragged

#: Pieces that a worker keeps; beyond them it starts anew.
KEEP = 600_000
SPACE, LETTER, DIGIT, OTHER = range(4)


def _latin_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and kind of each Latin-1 character, as the tokenizer's word pattern has them."""
    lower, kind = np.arange(256, dtype=np.uint8), np.full(256, OTHER, np.uint8)
    for c in range(256):
        if chr(c).isupper():
            lower[c] = ord(chr(c).lower())
        kind[c] = SPACE if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else LETTER if chr(c).isalpha() else DIGIT if chr(c).isnumeric() else OTHER
    return lower, kind


LOWER, KIND = _latin_tables()
_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load(path: str) -> Tokenizer:
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Encoder:
    def __init__(self, path: str):
        self.tok = load(path)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        size = self.tok.get_vocab_size()
        self.pieces = [(self.tok.id_to_token(i) or "").encode() for i in range(size)]
        self.final = np.array([p.endswith(b"</w>") for p in self.pieces])
        self.known: dict[bytes, bytes] = {}
        self.latin_cut = self._latin_words_hold()

    def _latin_words_hold(self) -> bool:
        """Whether this tokenizer cuts Latin-1 as latin_words does: a sample of all kinds of neighbours."""
        kinds = "aß9²'.!ªéµ$"
        probes = [x + y + z for x in kinds for y in kinds for z in kinds] + ["don't we'll I'd they've you're I'm", "it's'sx", "''s", "A\xa0b\x85c"]
        own = [[i for w in latin_words([p])[0].to_pylist() for i in self._whole(w.decode("latin-1"))] for p in probes]
        return own == [self._whole(p) for p in probes]

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes], latin: bool) -> None:
        texts = [p.decode("latin-1" if latin else "utf-8") for p in pieces]
        if latin and self.latin_cut:  # each piece is one word, which ends with a final token
            ids = np.array(self._whole(" ".join(texts)), "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(pieces):
                raw, at = ids.tobytes(), np.concatenate([[0], ends * 4]).tolist()
                self.known.update((p, raw[x:y]) for p, x, y in zip(pieces, at, at[1:], strict=False))
                return
        self.known.update((p, np.array(i, "<u4").tobytes()) for p, i in zip(pieces, self.whole(texts), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and len + 1 offsets."""
        n = len(texts)
        special = np.zeros(n, bool)
        for s in self.specials:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        latin = ~pc.match_substring_regex(texts, "[^\\x00-\\x{ff}]").to_numpy(zero_copy_only=False)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, ids, lengths
        for rows, low in ((np.flatnonzero(~special & latin), True), (np.flatnonzero(~special & ~latin), False)):
            if len(rows):
                parts.append((rows, *self._chunked(texts.take(pa.array(rows)), low)))
        if special.any():
            rows = np.flatnonzero(special)
            ids = self.whole(texts.take(pa.array(rows)).to_pylist())
            parts.append((rows, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)))
        if len(parts) == 1:
            return parts[0][1], np.concatenate([[0], np.cumsum(parts[0][2])])
        starts, lengths, base = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for rows, ids, count in parts:
            lengths[rows] = count
            starts[rows] = base + np.cumsum(count) - count
            base += len(ids)
        every = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint32)
        return every[ragged(starts, lengths)], np.concatenate([[0], np.cumsum(lengths)])

    def _chunked(self, texts: pa.Array, latin: bool) -> tuple[np.ndarray, np.ndarray]:
        if latin and self.latin_cut:
            flat, ends = latin_words(texts)
        else:
            lists = pc.ascii_split_whitespace(texts)
            flat, ends = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            latin = False
        coded = flat.dictionary_encode()
        index, pieces = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        if len(self.known) + len(pieces) > KEEP:
            self.known.clear()
        key = pieces if latin else [b"\n" + p for p in pieces]  # a piece in UTF-8 is not one in Latin-1
        new = [(k, p) for k, p in zip(key, pieces, strict=True) if k not in self.known]
        if new and latin:
            self._learn([p for _, p in new], True)
        elif new:
            self.known.update((k, np.array(i, "<u4").tobytes()) for (k, _), i in zip(new, self.whole([p.decode() for _, p in new]), strict=True))
        found = [self.known[k] for k in key]
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids_of = np.frombuffer(b"".join(found), "<u4")
        first = np.cumsum(length) - length
        counts = length[index]
        ids = ids_of[ragged(first[index], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[ends])

    def decode(self, ids: np.ndarray) -> bytes:
        """As the library's decode() without a decoder: the tokens' strings joined by a space."""
        return b" ".join(map(self.pieces.__getitem__, ids.tolist()))


def latin_words(texts: pa.Array | list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of Latin-1 texts, lower-cased, as Latin-1 bytes, and len + 1 offsets of texts: runs
    of letters, single digits, runs of other characters, and the seven endings after an apostrophe
    that begins a word."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    data, _ = buffers(texts)
    chars = LOWER[np.frombuffer(data.tobytes().decode().encode("latin-1"), np.uint8)]
    bounds = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    n, kind = len(chars), KIND[chars]
    if not n:
        return pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    start |= first[:n]
    quote = np.flatnonzero((chars == 0x27) & start)
    if len(quote):
        padded, edge = np.concatenate([chars, [0, 0, 0]]), np.concatenate([first, [True, True, True]])
        one, two = padded[quote + 1], padded[quote + 2]
        within1, within2 = ~edge[quote + 1], ~edge[quote + 1] & ~edge[quote + 2]
        short = within1 & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = within2 & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        for q, size in ((quote[short], 2), (quote[long], 3)):
            for k in range(1, size):
                start[q + k] = False
            after = q[q + size < n] + size
            start[after] = True
    solid = kind != SPACE
    start &= solid
    count = np.concatenate([[0], np.cumsum(start)])
    offsets = np.concatenate([np.flatnonzero(start[solid]), [int(solid.sum())]])
    return binaries(chars[solid], offsets), count[bounds]
