"""Token ids of whole texts with the ``tokenizers`` library.

Prose repeats its words. A text of Latin letters, digits, signs, spaces and newlines is cut into
the pre-tokens that the tokenizer would make, all texts of a slice at once on their bytes; each
distinct pre-token goes through the library's model once and its ids are gathered for all places.
A text with other characters or an apostrophe (contractions) is cut at spaces where the tokenizer
cuts too, and its distinct pieces are encoded. Where such a cut could change ids (runs of white
space before a space, a tokenizer of another kind), the whole text goes through the library.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scoreloom.llm.arrowtext import ranges

#: Distinct pieces and pre-tokens remembered by a Python worker (about 120 MB).
MEMORY_PIECES, MEMORY_PRETOKENS = 500_000, 400_000
#: Text encoded at once inside a task.
TEXT_BYTES = 4 << 20
_ANY_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Pieces whose pre-tokens _CUTS finds, by kind; apostrophes (contractions) are left to the library.
_SURE = {"joined": re.compile(rf"[ -&(-~{_LETTER}]*(?:\n[ -&(-~{_LETTER}]+)*\n?"), "dropped": re.compile(rf"[!-&(-~{_LETTER}]*")}
_CUTS = {"joined": re.compile(rf" ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\n| "), "dropped": re.compile(rf"[{_LETTER}]+|[0-9]|[^\s0-9{_LETTER}]+")}


_ID = attrgetter("id")
WHITE, LETTER, DIGIT, SIGN, ODD = range(5)


def _byte_classes() -> np.ndarray:
    """Class of each UTF-8 byte. 0xC3 begins the Latin letters (and two signs) from U+00C0 to
    U+00FF; a text with any other beginning, control character or apostrophe is odd."""
    out = np.full(256, ODD, np.uint8)
    out[33:127], out[128:192], out[0xC3] = SIGN, LETTER, LETTER
    for a, z in (b"AZ", b"az"):
        out[a : z + 1] = LETTER
    out[48:58], out[[10, 32]], out[39] = DIGIT, WHITE, ODD
    return out


_CLASS = _byte_classes()


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (no nulls) in a row, and their bounds."""
    _, offsets, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level BPE writes for each byte: printable ones stand for
    themselves, the others get the signs from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _kind(path: str) -> str:
    """'joined': byte-level pieces that begin with their space; 'dropped': white space
    is no part of any token; 'whole': neither is certain."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "joined"
    steps = pre.get("pretokenizers", [])
    plain = all(x["type"] in ("NFC", "Lowercase", "Replace") for x in (norm or {}).get("normalizers", [{"type": "?"}]))
    split = steps[0] if steps else {}
    if plain and split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and split["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+"):
        return "dropped"
    return "whole"


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind = _kind(path)
        self.pretokens: dict[str, list[int]] = {}
        self.sure, self.cuts, self.signs = _SURE.get(self.kind), _CUTS.get(self.kind), _byte_signs()
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # such strings in a text are ordinary text
        self._forget()
        self.tokens = pa.array([], pa.string())
        self.token_start, self.token_length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.token_pool = np.empty(0, np.uint32)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        if len(self.pretokens) > MEMORY_PRETOKENS:
            self.pretokens.clear()
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of distinct pieces."""
        if self.kind == "whole":
            return self._library(pieces)
        out, rest, seen, model = [], [], self.pretokens, self.tok.model
        sure, cuts, lower = self.sure.fullmatch, self.cuts.findall, self.kind == "dropped"
        for p in pieces:
            if not sure(p):
                rest.append(len(out))
                out.append([])
                continue
            ids: list[int] = []
            for t in cuts(p.lower() if lower else p):
                got = seen.get(t)
                if got is None:
                    got = seen[t] = [x.id for x in model.tokenize(t.encode().decode("latin-1").translate(self.signs))]
                ids += got
            out.append(ids)
        for i, ids in zip(rest, self._library([pieces[i] for i in rest])):
            out[i] = ids
        return out

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """A number for each piece; new ones are encoded and remembered."""
        if len(self.known) > MEMORY_PIECES:
            self._forget()
        known = self.known
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            ids = self._pieces(new)
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(length.sum()))
            self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(length) - length))
            self.length = np.concatenate((self.length, length))
            self.pool = np.concatenate((self.pool, flat))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def _keep_tokens(self, at: np.ndarray) -> None:
        """Forget all pre-tokens but those at the given places."""
        length = self.token_length[at]
        self.token_pool = self.token_pool[ranges(self.token_start[at], length)]
        self.token_start, self.token_length = np.cumsum(length) - length, length
        self.tokens = self.tokens.take(pa.array(at))

    def _token_ids(self, distinct: pa.Array) -> np.ndarray:
        """A number for each pre-token; new ones go through the model and are remembered."""
        model, lower = self.tok.model.tokenize, self.kind == "dropped"
        at = pc.index_in(distinct, value_set=self.tokens)
        if not at.null_count:
            return at.to_numpy(zero_copy_only=False)
        new = distinct.filter(at.is_null())
        if len(self.tokens) + len(new) > MEMORY_PRETOKENS:
            self._keep_tokens(at.drop_null().to_numpy(zero_copy_only=False))
        # all in one string for the change to byte signs; a plain text holds no \x01
        text = "\x01".join(t.lstrip(" \n") for t in new.to_pylist()) if lower else "\x01".join(new.to_pylist())
        signs = text.encode().decode("latin-1").translate(self.signs).split(self.signs[1])
        parts = [model(t) if t else [] for t in signs]
        each = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(map(_ID, chain.from_iterable(parts)), np.uint32, int(each.sum()))
        self.token_start = np.concatenate((self.token_start, len(self.token_pool) + np.cumsum(each) - each))
        self.token_length, self.token_pool = np.concatenate((self.token_length, each)), np.concatenate((self.token_pool, flat))
        self.tokens = pa.concat_arrays([self.tokens, new])
        return pc.index_in(distinct, value_set=self.tokens).to_numpy(zero_copy_only=False)

    def _by_tokens(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, and how many each text has. White space stands at the beginning of
        a pre-token; 'dropped' tokenizers pass over it."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        kind, wide = _CLASS[data], np.flatnonzero(data == 0xC3)
        second = data[wide + 1]
        sign = wide[(second == 0x97) | (second == 0xB7)]
        kind[sign] = kind[sign + 1] = SIGN
        white, start = kind == WHITE, np.zeros(len(data), bool)
        differs = kind[1:] != kind[:-1]
        has = bounds[1:] > bounds[:-1]
        if self.kind == "dropped":
            start[1:] = (differs | (kind[1:] == DIGIT)) & ~white[:-1]
            data = data.copy()
            data[(data >= 65) & (data <= 90)] += 32
            data[wide[(second < 0x9F) & (second != 0x97)] + 1] += 32
        else:
            start[1:] = differs & (data[:-1] != 32)
            last = bounds[1:][has] - 1
            at_end = start[last]
            start[1:-1] |= white[:-2] & white[1:-1] & ~white[2:]  # of a run of white space the last one stands alone
            start[last] = at_end
        start[bounds[:-1][has]] = True
        at = np.flatnonzero(start)
        offsets = np.append(at, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        number = self._token_ids(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        length = self.token_length[number]
        upto = np.concatenate(([0], np.cumsum(length)))[np.searchsorted(at, bounds)]
        return self.token_pool[ranges(self.token_start[number], length)], np.diff(upto)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any texts, and how many each text has."""
        n = len(texts)
        if self.kind == "whole":
            rough = np.ones(n, bool)
        elif self.kind == "joined":
            rough = pc.match_substring_regex(texts, _ANY_SPACE + " ").to_numpy(zero_copy_only=False)
        else:
            rough = np.zeros(n, bool)
            texts = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(pc.if_else(pa.array(rough), "", texts), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        first = np.cumsum(counts) - counts
        if self.kind == "joined":
            heads = [distinct[c] for c in codes[first]]
            numbers = self._numbers([" " + p for p in distinct] + heads)
            number = numbers[: len(distinct)][codes]
            number[first] = numbers[len(distinct) :]
        else:
            number = self._numbers(distinct)[codes]
        length = self.length[number]
        row_len = np.add.reduceat(length, first)
        flat = self.pool[ranges(self.start[number], length)]
        odd = np.flatnonzero(rough)
        if not len(odd):
            return flat, row_len
        whole = [np.asarray(x, np.uint32) for x in self._library(texts.take(pa.array(odd)).to_pylist())]
        parts = np.split(flat, np.cumsum(row_len)[:-1])
        for i, x in zip(odd, whole):
            parts[i] = x
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, n)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, `end_id` after each, and the bounds of each text in them."""
        texts = pc.fill_null(texts, "")
        data, bounds = _bytes_of(texts)
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(bounds, np.flatnonzero(_CLASS[data] == ODD), side="right") - 1] = True
        if self.kind == "whole":
            odd[:] = True
        if not odd.any():
            ids, size = self._by_tokens(data, bounds)
        else:
            plain, rest = ~odd, self._by_words(texts.filter(pa.array(odd)))
            ids, each = self._by_tokens(data[np.repeat(plain, np.diff(bounds))], np.concatenate(([0], np.cumsum(np.diff(bounds)[plain]))))
            size = np.empty(len(texts), np.int64)
            size[plain], size[odd] = each, rest[1]
        ends = np.concatenate(([0], np.cumsum(size + 1)))
        out = np.empty(int(ends[-1]), np.uint32)
        own = np.ones(len(out), bool)
        out[ends[1:] - 1], own[ends[1:] - 1] = end_id, False
        if odd.any():
            out[ranges(ends[:-1][odd], size[odd])] = rest[0]
            own[ranges(ends[:-1][odd], size[odd])] = False
        out[own] = ids
        return out, ends


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)
