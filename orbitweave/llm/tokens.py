"""Token ids of whole texts, for use inside tasks.

A tokenizer that drops white space encodes each word on its own, so a worker keeps
the ids of the words that it has met and hands only new ones to the tokenizers
library: by parts (runs of letters, digits, runs of marks) where its rules cut words
there anyway, so that only parts are kept and looked up. The ids equal those of the
whole text; tests compare them.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: By tokenizer file: the ids of words and parts met lately, and of those met before them.
_WORDS: dict[str, tuple[dict[bytes, bytes], dict[bytes, bytes]]] = {}
#: The same of numbers of ids of words.
_COUNTS: dict[str, tuple[dict[bytes, int], dict[bytes, int]]] = {}
_LOADED: dict[str, object] = {}
#: By tokenizer file, which ids end a part; None where words are not encoded by parts.
_ENDS: dict[str, np.ndarray | None] = {}
_KEEP_COUNTS, _KEEP_WORDS = 600_000, 500_000
#: Parts in one call of the library.
_JOINED = 64

#: The rules under which a plain word's ids are those of its parts, each in lower case.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Letters that NFC keeps and that have one lower case, digits, and marks that begin no added token and no ``'s``.
_PLAIN = re.compile(rb"(?:[!-&(-;=-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def _kinds() -> np.ndarray:
    """Kinds of bytes: 0 white space, 1 parts of plain letters, 2 digits, 3 marks, 4 what no plain word has."""
    kinds = np.full(256, 4, np.uint8)
    kinds[33:127] = 3
    kinds[list(b"'<")] = 4
    kinds[48:58] = 2
    kinds[65:91] = kinds[97:123] = kinds[0x80:0xC0] = kinds[0xC3] = 1
    kinds[list(b" \t\n\r\x0b\x0c")] = 0
    return kinds


_KINDS = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def default_tokenizer() -> str:
    """Path of the tokenizer file used unless another is given."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str):
    """The tokenizer of ``path``, once per Python worker."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def count_ids(texts: list[bytes | None], path: str) -> list[int]:
    """Numbers of ids of each text, by the words that ``encode_words`` would encode; each distinct word is looked up once."""
    known, older = _COUNTS.setdefault(path, ({}, {}))
    if len(known) > _KEEP_COUNTS:
        known, older = _COUNTS[path] = ({}, known)
    bounds, distinct, index = _distinct(texts)
    new = [w for w in distinct if w not in known]
    for word in [w for w in new if w in older]:
        known[word] = older[word]
    if new := [w for w in new if w not in known]:
        decoded = [w.decode("utf-8", "replace") for w in new]
        for word, e in zip(new, load(path).encode_batch_fast(decoded, add_special_tokens=False), strict=True):
            known[word] = len(e.ids)
    lengths = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
    return np.diff(np.concatenate([[0], np.cumsum(lengths[index])])[bounds]).tolist()


def _spread(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each with a blank after it, and where texts end."""
    raw = np.frombuffer(b" ".join([*(t or b"" for t in texts), b""]), np.uint8)
    return raw, np.cumsum([0, *(len(t or b"") + 1 for t in texts)])


def _numbered(letters: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct ones of the strings that begin at ``starts``, and which of them each is."""
    offsets = np.append(starts, len(letters))
    strings = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    _, ends, data = strings.dictionary.buffers()
    if not len(strings.dictionary):
        return [], strings.indices.to_numpy()
    ends, data = np.frombuffer(ends, np.int64)[: len(strings.dictionary) + 1].tolist(), data.to_pybytes()
    return [data[a:b] for a, b in zip(ends, ends[1:])], strings.indices.to_numpy()


def _distinct(texts: list[bytes | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """How many words come before each text and in all, the distinct words, and which of them each word is."""
    raw, bounds = _spread(texts)
    inside = _KINDS[raw] > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    words, index = _numbered(raw[inside], np.flatnonzero(first[inside]))
    return np.searchsorted(np.flatnonzero(first), bounds), words, index


def _distinct_parts(texts: list[bytes | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Like ``_distinct``, but of the parts of plain words, in lower case, and of other words."""
    raw, bounds = _spread(texts)
    kinds = _KINDS[raw]
    high = np.flatnonzero(raw >= 0x80)
    lower = _LOWER[raw]
    if len(high):
        # 0xC3 leads plain letters, but for the signs of times and divided by. A blank ends the bytes.
        byte, after, led = raw[high], raw[high + 1], raw[high - 1] == 0xC3
        follows = (byte >= 0x80) & (byte < 0xC0)
        lost = (byte == 0xC3) & ((after < 0x80) | (after >= 0xC0))
        sign = led & ((byte == 0x97) | (byte == 0xB7))
        kinds[high[lost | sign | (follows & ~led)]] = 4
        lower[high[led & follows & (byte < 0x9F)]] += 32
    edge = np.ones(len(raw), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
    edge |= kinds == 2
    odd = np.flatnonzero(kinds == 4)
    if len(odd):
        # Words with such bytes stay whole and as they are.
        blank = np.flatnonzero(kinds == 0)
        ends = np.unique(np.searchsorted(blank, odd))
        until = blank[ends]
        begin = np.where(ends > 0, blank[ends - 1] + 1, 0)
        sizes = until - begin
        place = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        lower[place] = raw[place]
        edge[place] = False
        edge[begin] = True
    inside = kinds > 0
    edge &= inside
    parts, index = _numbered(lower[inside], np.flatnonzero(edge[inside]))
    return np.searchsorted(np.flatnonzero(edge), bounds), parts, index


def encode_words(texts: list[bytes | None], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each UTF-8 text; null counts as empty.

    Only for tokenizers whose pre-tokenizer never joins characters across ASCII
    white space and drops it.
    """
    bounds, distinct, index = (_distinct if _part_ends(path) is None else _distinct_parts)(texts)
    ids = _known(distinct, path)
    lengths = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
    sizes = lengths.take(index)
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    place = np.repeat((np.cumsum(lengths) - lengths).take(index) - ends[:-1], sizes)
    place += np.arange(ends[-1])
    flat, edges = np.frombuffer(b"".join(ids), "<u4").take(place).tobytes(), (4 * ends[bounds]).tolist()
    return [flat[a:b] for a, b in zip(edges, edges[1:])]


def _known(words: list[bytes], path: str) -> list[bytes]:
    """Ids of distinct words and parts.

    Once ``_KEEP_WORDS`` were met, those not met again while as many others come
    are forgotten.
    """
    known, older = _WORDS.setdefault(path, ({}, {}))
    if len(known) > _KEEP_WORDS:
        known, older = _WORDS[path] = ({}, known)
    new = []
    for word in [w for w in words if w not in known]:
        if (ids := older.get(word)) is None:
            new.append(word)
        else:
            known[word] = ids
    ends = _part_ends(path)
    plain = list(filter(_PLAIN, new)) if ends is not None else []
    whole = [w for w in new if not _PLAIN(w)] if 0 < len(plain) < len(new) else [] if plain else new
    if plain:
        known.update(_encoded_parts(plain, ends, path))
    if whole:
        known.update(zip(whole, _encoded([w.decode("utf-8", "replace") for w in whole], path), strict=True))
    return list(map(known.__getitem__, words))


def _encoded(texts: list[str], path: str) -> list[bytes]:
    return [np.asarray(e.ids, "<u4").tobytes() for e in load(path).encode_batch_fast(texts, add_special_tokens=False)]


def _part_ends(path: str) -> np.ndarray | None:
    """Which ids end a part, if the tokenizer cuts words by ``_CUT`` and marks the ends of parts."""
    if path not in _ENDS:
        rules = json.loads(load(path).to_str())
        suffix = rules["model"].get("end_of_word_suffix")
        normal, cuts = (rules.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
        split, *rest = cuts.get("pretokenizers") or [{}]
        known = (
            normal.get("normalizers") == _NORMAL and split == {"type": "Split", "pattern": {"Regex": _CUT}, "behavior": "Removed", "invert": True}
            and len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0]["use_regex"] and not rest[0]["add_prefix_space"]
            and rules["model"]["type"] == "BPE" and not rules["model"]["dropout"] and suffix and rules["post_processor"] is None
            and all("<" in t["content"][:1] for t in rules["added_tokens"])
        )
        ends = None
        if known:
            vocab = load(path).get_vocab()
            ends = np.zeros(max(vocab.values()) + 1, bool)
            ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        _ENDS[path] = ends
    return _ENDS[path]


def _encoded_parts(parts: list[bytes], ends: np.ndarray, path: str) -> Iterator[tuple[bytes, bytes]]:
    """Parts with their ids: encoded many at a time and told apart by their last ids."""
    groups = [parts[at : at + _JOINED] for at in range(0, len(parts), _JOINED)]
    joined = [b" ".join(g).decode() for g in groups]
    for group, e in zip(groups, load(path).encode_batch_fast(joined, add_special_tokens=False), strict=True):
        ids = np.asarray(e.ids, "<u4")
        raw, to = ids.tobytes(), ((np.flatnonzero(ends[ids]) + 1) * 4).tolist()
        if len(to) == len(group):
            yield from zip(group, map(raw.__getitem__, map(slice, [0, *to[:-1]], to)), strict=True)
        else:
            yield from zip(group, _encoded([p.decode() for p in group], path), strict=True)
