"""Byte-pair encoding by dynamic programming over prefixes.

For every prefix of a word the last token of its encoding is stored, and with it the number of tokens: the encoding of a
prefix is the encoding of a shorter prefix plus one token, and exactly one token of the vocabulary is both a suffix of
the prefix and compatible with the last token of what is left. Two neighbouring tokens are compatible when undoing their
merges, latest first, never shows a merge across their border that the encoder would have made before.

Words share prefixes, so the table of prefixes is kept between words (bounded; it is emptied when full).
"""

from __future__ import annotations

import json
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the pre-tokenisation pattern of the byte-level tokenizers.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words longer than this are encoded in arrays of their own, so that the shared table's keys stay short.
LONG = 64

#: The rank of a pair that doesn't merge.
NEVER = (1 << 31) - 1

#: A change of the count as a signed byte.
CHANGE = {n: bytes([n & 255]) for n in range(-127, 128)}


def byte_alphabet() -> list[str]:
    """The printable character for each byte: itself where it is printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PrefixTable:
    """Token counts and ids of words, from the table of all their prefixes."""

    def __init__(self, model: dict, most_prefixes: int = 600_000) -> None:
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        size = max(self.vocab.values()) + 1
        self.rank = [-1] * size
        self.parts: list[tuple[int, int]] = [(-1, -1)] * size
        self.length = [0] * size
        self.merge: dict[int, int] = {}
        for piece, i in self.vocab.items():
            bare = piece[: -len(self.suffix)] if self.suffix and piece.endswith(self.suffix) else piece
            self.length[i] = len(bare)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list | tuple) else pair.split(" ")
            a, b, made = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.merge[a << 20 | b] = rank
            self.rank[made] = rank
            self.parts[made] = (a, b)
        self.longest = max(self.length)
        #: Every end of a token, with the token's id where the end is a token itself.
        self.ends: dict[str, int] = {}
        #: The same of the tokens that carry the end-of-word suffix, without it.
        self.tails: dict[str, int] = {}
        for piece, i in self.vocab.items():
            closed = bool(self.suffix) and piece.endswith(self.suffix)
            bare, known = (piece[: -len(self.suffix)], self.tails) if closed else (piece, self.ends)
            for start in range(1, len(bare)):
                known.setdefault(bare[start:], -1)
            known[bare] = i
        self.most = most_prefixes
        self.table: dict[str, tuple[int, int, bytes]] = {}
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        alphabet = byte_alphabet()
        self.letters = {b: alphabet[b] for b in range(256)}

    def spelled(self, word: str) -> str:
        """The word in the alphabet of the vocabulary: a character for each UTF-8 byte."""
        return word.encode().decode("latin-1").translate(self.letters)

    def _border(self, a: int, b: int, limit: int) -> bool:
        """No merge across the border of a and b comes before ``limit`` while their own merges are undone, latest first."""
        merge, rank, parts = self.merge, self.rank, self.parts
        while True:
            across = merge.get(a << 20 | b)
            if across is not None and across < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                limit, a = ra, parts[a][1]
            elif rb >= 0:
                limit, b = rb + 1, parts[b][0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self._border(a, b, 1 << 40)
        return known

    def alone(self, t: int) -> bool:
        """The token's own text is encoded as that token."""
        known = self.whole.get(t)
        if known is None:
            a, b = self.parts[t]
            known = self.whole[t] = a < 0 or (self.alone(a) and self.alone(b) and self._border(a, b, self.rank[t]))
        return known

    def _last(self, s: str, end: int, lasts: list[int], tail: str) -> int:
        """The last token of the prefix of length ``end``; ``lasts[i]`` is that of the prefix of length i."""
        vocab = self.vocab
        for start in range(max(0, end - self.longest), end):
            t = vocab.get(s[start:end] + tail)
            if t is not None and (self.alone(t) if start == 0 else self.compatible(lasts[start], t)):
                return t
        raise ValueError(f"no token ends {s[:end]!r}")

    def prefixes(self, s: str) -> list[tuple[int, int]]:
        """(last token, number of tokens) of every prefix of a spelled word, without an end-of-word suffix."""
        n = len(s)
        if n > LONG:
            lasts, counts = [-1], [0]
            for end in range(1, n + 1):
                t = self._last(s, end, lasts, "")
                lasts.append(t)
                counts.append(counts[end - self.length[t]] + 1)
            return list(zip(lasts[1:], counts[1:], strict=True))
        self.state(s)
        table = self.table
        return [table[s[:end]][:2] for end in range(1, n + 1)]

    def state(self, s: str) -> tuple[int, int, bytes]:
        """(last token, number of tokens, change of that number at each byte as int8) of a spelled word of at most LONG bytes."""
        table = self.table
        got = table.get(s)
        if got is not None:
            return got
        if len(table) > self.most:
            table.clear()
        known = len(s) - 1
        while known and s[:known] not in table:
            known -= 1
        got = table[s[:known]] if known else (-1, 0, b"")
        ends, compatible = self.ends, self.compatible
        for end in range(known + 1, len(s) + 1):
            p = s[:end]
            found = []
            for start in range(end - 1, -1, -1):
                t = ends.get(p[start:])
                if t is None:
                    break
                if t >= 0:
                    found.append((start, t))
            for start, t in reversed(found):
                if start == 0:
                    if self.alone(t):
                        count = 1
                        break
                else:
                    before = table[p[:start]]
                    if compatible(before[0], t):
                        count = before[1] + 1
                        break
            else:
                raise ValueError(f"no token ends {p!r}")
            got = table[p] = (t, count, got[2] + CHANGE[count - got[1]])
        return got

    def ids(self, s: str) -> list[int]:
        """The ids of a spelled word; its last symbol carries the end-of-word suffix, if the model has one."""
        if not s:
            return []
        n, length = len(s), self.length
        if n > LONG:
            lasts = [-1, *(t for t, _ in self.prefixes(s[:-1] if self.suffix else s))]
            out = [self._last(s, n, lasts, self.suffix) if self.suffix else lasts[n]]
            at = n - length[out[0]]
            while at:
                out.append(lasts[at])
                at -= length[lasts[at]]
            return out[::-1]
        table = self.table
        if self.suffix:
            if n > 1:
                self.state(s[:-1])
            found = []
            for start in range(n - 1, -1, -1):
                t = self.tails.get(s[start:])
                if t is None:
                    break
                if t >= 0:
                    found.append((start, t))
            for start, t in reversed(found):  # noqa: B007
                if self.alone(t) if start == 0 else self.compatible(table[s[:start]][0], t):
                    break
            else:
                raise ValueError(f"no token ends {s!r}")
        else:
            t = self.state(s)[0]
        out = [t]
        at = n - length[t]
        while at:
            t = table[s[:at]][0]
            out.append(t)
            at -= length[t]
        return out[::-1]


class ByteCounter:
    """Exact token counts of every prefix of a text, as a byte-level tokenizer file gives them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dp = PrefixTable(spec["model"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.pattern = regex.compile(BYTE_PATTERN)
        self.cache: dict[str, tuple[int, bytes]] = {}
        self.words: dict[str, tuple[int, int, bytes]] = {}

    def word(self, token: str) -> list[int]:
        return [c for _, c in self.dp.prefixes(self.dp.spelled(token))]

    def ordinary(self, text: str) -> list[int]:
        """Token counts at every byte prefix of a text without special tokens.

        A prefix that ends in white space is one run of it, although the whole text leaves the run's last character to
        the next word; and a prefix of a contraction longer than two is a quote and a letter.
        """
        out: list[int] = []
        base, start, before = 0, 0, ""
        for token in self.pattern.findall(text):
            counts = self.word(token)
            if len(token) == 3 and token in ("'re", "'ve", "'ll"):
                counts[1] = 2
            shown = counts
            if before and token[0].isspace():
                first = len(token[0].encode())
                shown = list(counts)
                shown[first - 1] = self.word(before + token[0])[-1] - (base - start)
            out.extend(base + c for c in shown)
            start = base
            base += counts[-1]
            before = token if token.isspace() else ""
        self.total = base
        return out

    def prefix_counts(self, text: str) -> tuple[int, list[int]]:
        """(tokens of the text, tokens of every byte prefix). Counts inside a character are those of its bytes alone."""
        if self.split_special is None or not any(s in text for s in self.special):
            counts = self.ordinary(text)
            return self.total, counts
        out: list[int] = []
        base, at = 0, 0
        for hit in self.split_special.finditer(text):
            segment, literal = text[at : hit.start()], hit.group()
            counts = self.ordinary(segment + literal[:-1])
            self.ordinary(segment)
            whole = self.total
            out.extend(base + c for c in counts)
            base += whole + 1
            out.append(base)
            at = hit.end()
        counts = self.ordinary(text[at:])
        out.extend(base + c for c in counts)
        return base + self.total, out

    def measure(self, chunk: str) -> tuple[int, bytes]:
        """(tokens, change of the count at each byte as int8) of a text that is independent of its neighbours."""
        if len(chunk.encode()) <= LONG and "'" not in chunk and chunk[1:].split() == [chunk[1:]] and not any(s in chunk for s in self.special):
            # No run of white space and no contraction: the words' own changes stand end to end.
            total, deltas = 0, b""
            for token in self.pattern.findall(chunk):
                got = self.words.get(token)
                if got is None:
                    if len(self.words) > 400_000:
                        self.words.clear()
                    got = self.words[token] = self.dp.state(self.dp.spelled(token))
                total += got[1]
                deltas += got[2]
            return total, deltas
        total, counts = self.prefix_counts(chunk)
        last = 0
        changes = bytearray()
        for c in counts:
            changes.append((c - last) & 255)
            last = c
        return total, bytes(changes)

    def piece(self, chunk: str) -> tuple[int, bytes]:
        """``measure`` of a word with what it stands next to, kept for the next time."""
        got = self.cache.get(chunk)
        if got is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            got = self.measure(chunk)
            if len(chunk) <= 256:
                self.cache[chunk] = got
        return got


@lru_cache(maxsize=4)
def byte_counter(path: str) -> ByteCounter:
    return ByteCounter(path)


def spaced_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at every space: the distinct pieces, each piece's index into them, and where each text's pieces begin."""
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(lists.values.slice(offsets[0], offsets[-1] - offsets[0]))
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0]


def taken(flat: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` that have the given lengths, for i in index, end to end, and where each begins."""
    begins = np.cumsum(lengths) - lengths
    sizes = lengths[index]
    at = np.zeros(len(index) + 1, dtype=np.int64)
    np.cumsum(sizes, out=at[1:])
    kind = np.int32 if at[-1] < 2**31 and len(flat) < 2**31 else np.int64
    where = np.arange(at[-1], dtype=kind)
    where += np.repeat((begins[index] - at[:-1]).astype(kind), sizes)
    return flat[where], at


def gathered(parts: list[bytes], index: np.ndarray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The arrays ``parts[i]`` for i in index, end to end, and where each begins (one more than there are)."""
    size = np.dtype(dtype).itemsize
    lengths = np.fromiter((len(p) // size for p in parts), dtype=np.int64, count=len(parts))
    return taken(np.frombuffer(b"".join(parts), dtype=dtype), lengths, index)


class WordIds:
    """Ids of a lower-casing word tokenizer that drops white space; pieces between spaces are independent of each other."""

    #: Fixed value: the tokenizer's pattern; a space is added to it, to find the borders of pieces that are joined.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = regex.compile(self.PATTERN)
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.base = np.array([vocab[c] for c in alphabet], dtype=np.int32)
        self.closed = np.array([vocab[c + suffix] for c in alphabet], dtype=np.int32)
        merges = [pair if isinstance(pair, list | tuple) else pair.split(" ") for pair in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)

    @cached_property
    def dp(self) -> PrefixTable:
        """The table of prefixes, loaded on the first word above ``LONG``."""
        with open(self.path, encoding="utf-8") as f:
            return PrefixTable(json.load(f)["model"])

    @cached_property
    def library(self):
        """The library's tokenizer, loaded on the first piece that is left to it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.int32(NEVER))

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, number of each word's): merges run over all words at once, lowest rank first.

        Each step makes the best merge of every word that still has one. Words above ``LONG`` bytes, where that would be
        many steps, are taken from the table of prefixes.
        """
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        short = sizes <= LONG
        data = np.frombuffer("".join(words.filter(pa.array(short)).to_pylist()).encode(), dtype=np.uint8)
        n = sizes[short]
        ends = np.cumsum(n)
        tok = self.base[data]
        tok[ends - 1] = self.closed[data[ends - 1]]
        of = np.repeat(np.arange(len(n), dtype=np.int32), n)
        rank = np.full(len(tok), NEVER, dtype=np.int32)
        inner = np.flatnonzero(of[:-1] == of[1:])
        rank[inner] = self._ranks(tok[inner], tok[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(tok):
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            going = np.repeat(best < NEVER, np.diff(starts, append=len(of)))
            if not going.all():
                done.append((of[~going], tok[~going]))
                tok, of, rank = tok[going], of[going], rank[going]
                if not len(tok):
                    break
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                best = np.minimum.reduceat(rank, starts)
            hit = rank == np.repeat(best, np.diff(starts, append=len(of)))
            if (hit[1:] & hit[:-1]).any():  # a run of one token merges in pairs from the left
                place = np.arange(len(hit))
                first = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, -1))
                hit &= (place - first) % 2 == 0
            at = np.flatnonzero(hit)
            tok[at] = self.made[rank[at]]
            keep = np.ones(len(tok), dtype=bool)
            keep[at + 1] = False
            tok, of = tok[keep], of[keep]
            rank = rank[keep]
            now = at - np.arange(len(at))  # where the merged tokens stand after the gaps are closed
            mark = np.zeros(len(tok), dtype=bool)
            mark[now] = True
            mark[now[now > 0] - 1] = True
            touched = np.flatnonzero(mark)
            rank[touched] = NEVER
            touched = touched[touched + 1 < len(tok)]
            touched = touched[of[touched] == of[touched + 1]]
            rank[touched] = self._ranks(tok[touched], tok[touched + 1])
        which = np.concatenate([d[0] for d in done] or [np.zeros(0, np.int64)])
        ids = np.concatenate([d[1] for d in done] or [np.zeros(0, np.int64)])
        order = np.argsort(which, kind="stable")
        ids, counts = ids[order].astype("<u4"), np.bincount(which, minlength=len(n))
        if short.all():
            return ids, counts
        lengths = np.zeros(len(sizes), dtype=np.int64)
        lengths[short] = counts
        long = {i: self.dp.ids(self.dp.spelled(words[i].as_py())) for i in np.flatnonzero(~short).tolist()}
        for i, got in long.items():
            lengths[i] = len(got)
        begins = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), dtype="<u4")
        out[np.repeat(short, lengths)] = ids
        for i, got in long.items():
            out[begins[i] : begins[i] + len(got)] = got
        return out, lengths

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces end to end, number of each piece's); pieces hold no space.

        Beyond the first Latin blocks and where a special token's text occurs the library itself is asked.
        """
        names = pieces.to_pylist()
        other = {i: None for i, p in enumerate(names) if not (p.isascii() or max(p) < "ɐ") or ("<|" in p and any(s in p for s in self.special))}
        for i in other:
            other[i] = self.library.encode(names[i], add_special_tokens=False).ids
            names[i] = ""
        joined = " ".join(names)
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined)
        tokens = pa.array(self.pattern.findall(joined.lower()), pa.string())
        coded = pc.dictionary_encode(tokens)
        index = coded.indices.to_numpy(zero_copy_only=False)
        space = pc.index(coded.dictionary, " ").as_py()
        border = index == space
        ids, counts = self.words(coded.dictionary)
        if space >= 0:  # a border has no ids
            counts = counts.copy()
            begin = int(counts[:space].sum())
            ids = np.delete(ids, slice(begin, begin + int(counts[space])))
            counts[space] = 0
        flat, _ = taken(ids, counts, index)
        per_piece = np.bincount(np.cumsum(border), weights=counts[index], minlength=len(names)).astype(np.int64) if len(names) else np.zeros(0, np.int64)
        if not other:
            return flat, per_piece
        mine = np.ones(len(names), dtype=bool)
        mine[list(other)] = False
        final = per_piece.copy()
        for i, got in other.items():
            final[i] = len(got)
        at = np.cumsum(final) - final
        out = np.empty(int(final.sum()), dtype="<u4")
        out[np.repeat(mine, final)] = flat
        for i, got in other.items():
            out[at[i] : at[i] + len(got)] = got
        return out, final


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
