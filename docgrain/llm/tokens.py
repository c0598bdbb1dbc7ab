"""Exact, fast encoding of whole texts with public tokenizers, inside Arrow functions.

A text's tokens are the concatenation of the tokens of its safe pieces: the pieces between single
spaces, which no pre-token of the two supported tokenizers crosses. Arrow splits a block of texts
at these places and dictionary-encodes the pieces, so that the library sees each distinct piece of
a worker once; numpy then gathers lengths or ids. Texts to which this argument doesn't apply (runs
of white space, special strings) go to the library itself, cut at safe boundaries if long. The rules
hold for two kinds of tokenizer, which are told by their own settings; with any other, every text
goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_model

#: White space of Unicode, and the four separators that some engines count too.
_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PY_WS = re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), _WS)
#: A space between two characters that aren't white space: every tokenizer here starts a new token there.
_CUT = re.compile(rf"(?<=[^{_PY_WS}]) (?=[^{_PY_WS}])")
#: Bytes of text that are encoded at a time, and the size at which a single text is cut.
BLOCK_BYTES = 8 << 20
CUT_CHARS = 1 << 16
#: What a worker remembers: this many distinct pieces of so many bytes in all. Beyond, it forgets those
#: that it met in one block only.
KNOWN, KNOWN_BYTES = 600_000, 12 << 20
_MARK = "\x01"

# The settings of tokenizers that the rules below hold for.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def kind_of(tok) -> str:
    """``spaced``: byte-level BPE, whose tokens keep the space before a word; ``words``: white space is
    dropped and letters lose their case; ``other``: neither, or with special strings that reach beyond
    themselves."""
    state = lambda x: json.loads(x.__getstate__()) if x is not None else None
    for t in tok.get_added_tokens_decoder().values():
        if t.lstrip or t.rstrip or t.single_word or t.normalized or not re.fullmatch(r"\S+", t.content):
            return "other"
    normal, pre = state(tok.normalizer), state(tok.pre_tokenizer) or {}
    if normal is None and all(pre.get(k) == v for k, v in _BYTES.items()):
        return "spaced"
    steps = [x.get("type") for x in (normal or {}).get("normalizers", [])]
    splits = pre.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == ["Split", "ByteLevel"]:
        if splits[0]["pattern"] == {"Regex": _WORDS} and splits[0]["behavior"] == "Removed" and splits[0]["invert"]:
            return "words"
    return "other"


class Encoder:
    """One tokenizer file; see :func:`kind_of`. ``light``: with two thirds of the cache and an eighth of the block."""

    def __init__(self, path: str, light: bool = False):
        self.most, self.most_bytes, self.block = KNOWN, KNOWN_BYTES, BLOCK_BYTES
        if light:
            self.most, self.most_bytes, self.block = KNOWN * 2 // 3, KNOWN_BYTES * 2 // 3, BLOCK_BYTES // 8
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = kind_of(self.tok)
        self.spaced = self.kind == "spaced"
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.many = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.known: dict[str, int] = {}
        self.bytes = self.used = 0
        self.lens, self.ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.met = np.zeros(1 << 16, np.int32)

    def _forget(self) -> None:
        """Drops all pieces but those met in two blocks or more (all, if these are too many as well)."""
        n = len(self.known)
        keep = np.flatnonzero(self.met[:n] > 1)
        if len(keep) > self.most // 2:
            keep = keep[:0]
        pieces = list(self.known)
        pieces = [pieces[k] for k in keep.tolist()]
        lens = self.lens[:n]
        start, lens = (np.cumsum(lens, dtype=np.int64) - lens)[keep], lens[keep]
        ends = np.cumsum(lens, dtype=np.int64)
        used = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(start - (ends - lens), lens) + np.arange(used)]
        self.known = dict(zip(pieces, range(len(pieces))))
        self.bytes, self.used = sum(map(len, pieces)), used
        self.lens, self.ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.met = np.zeros(1 << 16, np.int32)
        self._room(len(pieces), used)
        self.lens[: len(pieces)], self.ids[:used] = lens, ids

    def _room(self, pieces: int, ids: int) -> None:
        """Makes the tables as long as asked for, at least."""
        while pieces > len(self.lens):
            self.lens = np.concatenate([self.lens, np.zeros_like(self.lens)])
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        while ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])

    def _learn(self, pieces: list[str]) -> None:
        """Encodes the pieces and remembers their tokens."""
        k = len(self.known)
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            got = self._encode(part)
            flat = np.fromiter(chain.from_iterable(got), np.uint32)
            self._room(k + len(part), self.used + len(flat))
            self.lens[k : k + len(part)] = np.fromiter(map(len, got), np.int32, len(part))
            self.ids[self.used : self.used + len(flat)] = flat
            self.known.update(zip(part, range(k, k + len(part))))
            self.used += len(flat)
            self.bytes += sum(map(len, part))
            k += len(part)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.many(texts, add_special_tokens=False)]

    def _whole(self, text: str) -> list[int]:
        """Tokens of one text by the library, long ones cut at safe boundaries."""
        if len(text) <= CUT_CHARS or self.kind == "other":
            return self._encode([text])[0]
        cuts, at = [0], 0
        while len(text) - at > CUT_CHARS:
            m = _CUT.search(text, at + CUT_CHARS)
            if m is None:
                break
            at = m.start()
            cuts.append(at)
        return list(chain.from_iterable(self._encode([text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])])))

    def blocks(self, texts: pa.Array, ids: bool):
        """Yields (first row, token counts, ids or None) for blocks of about BLOCK_BYTES.

        ids: one uint32 array per row, of its tokens in order. Null texts count as empty.
        """
        sizes = pc.fill_null(pc.binary_length(texts), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < len(texts):
            base = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, base + self.block, "right")))
            block = pc.fill_null(texts.slice(a, b - a).cast(pa.large_string()), "")
            yield (a, *self._block(block, ids))
            a = b

    def _odd(self, texts: pa.Array) -> np.ndarray:
        if self.kind == "other":
            return np.ones(len(texts), bool)
        odd = pc.match_substring(texts, _MARK)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        more = f"[{_WS}][{_WS}]" if self.spaced else r"\p{M}"
        return pc.or_(odd, pc.match_substring_regex(texts, more)).to_numpy(zero_copy_only=False)

    def _block(self, texts: pa.Array, ids: bool):
        n = len(texts)
        odd = self._odd(texts)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        counts, out = np.zeros(n, np.int64), [None] * n if ids else None
        where = np.flatnonzero(~odd)
        if len(plain):
            c, rows = self._plain(plain, ids)
            counts[where] = c
            if ids:
                for i, r in zip(where, rows):
                    out[i] = r
        for i in np.flatnonzero(odd):
            r = np.asarray(self._whole(texts[int(i)].as_py()), np.uint32)
            counts[i] = len(r)
            if ids:
                out[i] = r
        return counts, out

    def _plain(self, texts: pa.Array, ids: bool):
        if self.spaced:
            marked = pc.replace_substring(pc.replace_substring(texts, " ", _MARK + " "), "\n", f"{_MARK}\n{_MARK}")
        else:
            marked = pc.ascii_lower(pc.replace_substring(pc.replace_substring(texts, "\n", _MARK), " ", _MARK))
        # No token joins a letter to a following mark of these.
        marked = pc.replace_substring_regex(marked, "([a-z])([.,!|$%&*#])", f"\\1{_MARK}\\2")
        pieces = pc.split_pattern(marked, _MARK)
        offsets = np.asarray(pieces.offsets) - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > self.most or self.bytes > self.most_bytes:
            self._forget()
        row = np.fromiter((self.known.get(w, -1) for w in distinct), np.int64, len(distinct))
        new = np.flatnonzero(row < 0)
        row[new] = np.arange(len(self.known), len(self.known) + len(new))
        self._learn([distinct[i] for i in new])
        self.met[row] += 1
        index = row[coded.indices.to_numpy(zero_copy_only=False)]
        each = self.lens[index]
        total = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        bounds = total[offsets]
        counts = np.diff(bounds)
        if not ids:
            return counts, None
        lens = self.lens[: len(self.known)]
        start = (np.cumsum(lens, dtype=np.int64) - lens)[index]
        take = np.repeat((start - total[:-1]).astype(np.int32), each)  # a block has far fewer than 2**31 tokens
        take += np.arange(total[-1], dtype=np.int32)
        got = self.ids[take]
        return counts, [got[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def encoder(path: str, light: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer file; loaded once as long as no other model is asked for."""
    return worker_model(("tokens", path, light), lambda: Encoder(path, light))
