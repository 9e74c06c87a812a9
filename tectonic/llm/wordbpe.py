"""Word-level BPE over a public vocabulary file, by a prefix-sharing trie traversal.

The vocabulary marks the end of a word with a suffix, so a word is a string of byte symbols whose last
one is a marked symbol. For every prefix of a word the BPE encoding has one last token, and a token t
may follow token u exactly if BPE keeps the pair (u, t) as it is; the last token of a prefix therefore
follows from the last tokens of its shorter prefixes. Words in sorted order are a trie in preorder: the
stack of last-token states holds the path to the current word, and what a word shares with the one
before it is not computed again (``walk``). Which tokens end at a prefix is the state of a suffix-link
automaton over the vocabulary, one step per symbol. Many words at once are the same trie as arrays in
preorder, whose states pass from parents to children one depth at a time (``walk_together``).

Encodings of words are kept in two generations: when the younger is full the older one goes, and words
that were met since have moved on, so frequent words stay however many rare ones pass.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property
from struct import pack

import numpy as np

from .common import give_back
from .textnum import PolyHash, random_table

MAX_CACHED_WORDS = 200_000    # of a generation
MAX_CACHED_PAIRS = 500_000
MAX_CACHED_STEPS = 500_000
PAIR_SLOTS = 1 << 20          # of the array cache of pairs
SLICE_BYTES = 1 << 20         # of texts encoded together: the more, the more words they share
LONG_WORD = 48                # bytes; longer words go one by one
WORD_START = 0xFFFF           # stands for no token before


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for the characters from U+0100 on, in order."""
    keep = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def _slots(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) & (PAIR_SLOTS - 1)


class WordBPE:
    """Encoder and decoder for one vocabulary file; caches the encodings of words it has met."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.vocab: dict[str, int] = model["model"]["vocab"]
        self.suffix: str = model["model"]["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in self.added) + ")")
        #: From U+0300 on (combining marks and other scripts), and the dotted I, whose lower case has one.
        self.uncommon = re.compile("[\u0130\u0300-\U0010ffff]")
        self.symbols = byte_symbols()
        self.byte_of = {s: b for b, s in enumerate(self.symbols)}
        self.made = {a + b: (i, a, b) for i, (a, b) in enumerate(pairs)}
        self._automaton()
        self.poly = PolyHash(11)
        self.code_hash = random_table(12, 0x300)
        self._classes()
        self._token_bytes()
        self.fits: dict[int, bool] = {}
        self.steps: dict[int, int] = {}
        self.reset()

    @cached_property
    def library(self):
        """The library's tokenizer: its normaliser and word split serve unusual texts."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def reset(self) -> None:
        """Forget all words."""
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def word_bytes(self, word: str) -> bytes:
        """The bytes that a word's symbols stand for."""
        return bytes(map(self.byte_of.__getitem__, word))

    def _automaton(self) -> None:
        """Trie of all token spellings without the end mark, with suffix links.

        Per node the nearest node on its suffix chain, itself included, whose spelling is a token inside a
        word, and likewise for tokens that end one; 0, the root, is none.
        """
        n_suffix = len(self.suffix)
        child: dict[int, int] = {}
        inner, final, self.length = [0], [0], [0] * (max(self.tokens) + 1)
        inner_token, final_token = [-1], [-1]
        parent_key = [0]
        for token, number in self.vocab.items():
            ends = token.endswith(self.suffix)
            spelling = self.word_bytes(token[:-n_suffix] if ends else token)
            self.length[number] = len(spelling)
            node = 0
            for c in spelling:
                key = node << 8 | c
                node = child.get(key, 0)
                if not node:
                    node = child[key] = len(inner_token)
                    inner_token.append(-1)
                    final_token.append(-1)
                    parent_key.append(key)
            (final_token if ends else inner_token)[node] = number
        size = len(inner_token)
        fail, inner, final = [0] * size, [0] * size, [0] * size
        depth = [0] * size
        for node in range(1, size):
            depth[node] = depth[parent_key[node] >> 8] + 1      # a parent's number is smaller
        for node in sorted(range(1, size), key=depth.__getitem__):
            parent, c = parent_key[node] >> 8, parent_key[node] & 255
            link = 0
            if parent:
                link = fail[parent]
                while link and (link << 8 | c) not in child:
                    link = fail[link]
                link = child.get(link << 8 | c, 0)
            fail[node] = link
            inner[node] = node if inner_token[node] >= 0 else inner[link]
            final[node] = node if final_token[node] >= 0 else final[link]
        self.child, self.fail = child, fail
        self.inner, self.final, self.inner_token, self.final_token = inner, final, inner_token, final_token
        keys = np.fromiter(child, np.int64, len(child))
        order = np.argsort(keys)
        self.child_keys, self.child_nodes = keys[order], np.fromiter(child.values(), np.int64, len(child))[order]
        self.fail_array, self.length_array = np.array(fail), np.array(self.length)
        self.near = {False: (np.array(inner), np.array(inner_token)), True: (np.array(final), np.array(final_token))}
        self.pair_keys, self.pair_fits = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)

    def _token_bytes(self) -> None:
        """Bytes of every token as the decoder shows it, each with a space behind it, end to end."""
        shown = [(self.tokens.get(i, "") + " ").encode() for i in range(max(self.tokens) + 1)]
        self.shown_size = np.array([len(t) for t in shown], np.int64)
        self.shown_first = np.cumsum(self.shown_size) - self.shown_size
        self.shown_bytes = np.frombuffer(b"".join(shown), np.uint8)

    # ---- pair rule -----------------------------------------------------------------

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: merge the best-ranked neighbours, leftmost first, until none is left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best, at = min((self.ranks.get((symbols[i], symbols[i + 1]), 1 << 60), i) for i in range(len(symbols) - 1))
            if best == 1 << 60:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def symbols_of(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and token != self.suffix:
            body = token[:-len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def whole(self, token: str) -> bool:
        """Whether BPE turns the token's own symbols into the token."""
        return self.merge(self.symbols_of(token)) == [token]

    def follows(self, before: int, token: int) -> bool:
        """Whether BPE leaves ``before`` and ``token`` as they are side by side (WORD_START: a word's start).

        Walks back the merges that made the two: at each point the symbols at the seam may merge only
        if that merge ranks before the next one that uses either of them, the left one first on a tie.
        """
        key = before << 16 | token
        known = self.fits.get(key)
        if known is not None:
            return known
        if len(self.fits) > MAX_CACHED_PAIRS:
            self.fits.clear()
        right = self.tokens[token]
        if before == WORD_START:
            known = self.whole(right)
        else:
            known, limit, left = self.follows(WORD_START, token), 1 << 60, self.tokens[before]
            while known:
                if self.ranks.get((left, right), 1 << 60) < limit:
                    known = False
                    break
                made_left, made_right = self.made.get(left, (-1,))[0], self.made.get(right, (-1,))[0]
                if made_left > made_right:
                    limit, left = made_left, self.made[left][2]
                elif made_right >= 0:
                    limit, right = made_right + 1, self.made[right][1]
                else:
                    break
        self.fits[key] = known
        return known

    # ---- trie ----------------------------------------------------------------------

    def encode_words(self, words: list[str]) -> Iterator[list[str]]:
        """Tokens of distinct words given in byte symbols and in the order of their bytes."""
        for ids in self.walk([self.word_bytes(w) for w in words]):
            yield [self.tokens[i] for i in ids]

    def walk(self, words: list[bytes]) -> Iterator[list[int]]:
        """Token ids of distinct words given in sorted order."""
        fits, follows, length, fail = self.fits, self.follows, self.length, self.fail
        inner, final, inner_token, final_token, steps, step = self.inner, self.final, self.inner_token, self.final_token, self.steps, self._step
        nodes = [0]              # automaton state after each byte of the current path
        path: list[int] = []     # and the last token there
        last = b""
        for word in words:
            end = len(word) - 1
            shared, most = 0, min(end, len(path))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del path[shared:], nodes[shared + 1:]
            node, size = nodes[shared], shared
            for c in word[shared:end]:
                size += 1
                key = node << 8 | c
                node = steps.get(key)
                if node is None:
                    node = step(key)
                at = inner[node]
                while True:
                    token = inner_token[at]
                    start = size - length[token]
                    key = (path[start - 1] if start else 0xFFFF) << 16 | token
                    fit = fits.get(key)
                    if fit or fit is None and follows(key >> 16, token):
                        break
                    at = inner[fail[at]]
                path.append(token)
                nodes.append(node)
            key = node << 8 | word[end]
            node = steps.get(key)
            if node is None:
                node = step(key)
            at = final[node]
            while True:
                token = final_token[at]
                start = end + 1 - length[token]
                key = (path[start - 1] if start else 0xFFFF) << 16 | token
                fit = fits.get(key)
                if fit or fit is None and follows(key >> 16, token):
                    break
                at = final[fail[at]]
            found = [token]
            while start:
                token = path[start - 1]
                found.append(token)
                start -= length[token]
            found.reverse()
            yield found
            last = word

    def walk_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct words in sorted order, end to end, and how many each word has."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        most = int(size.max(initial=1))
        done = np.cumsum(size) - size
        column = np.arange(size.sum()) - np.repeat(done, size)
        spelled = np.zeros((n, most), np.int64)
        spelled[np.repeat(np.arange(n), size), column] = np.frombuffer(b"".join(words), np.uint8)
        before = np.concatenate([[0], size[:-1]])
        same = np.zeros((n, most + 1), bool)
        same[1:, :-1] = spelled[1:] == spelled[:-1]
        shared = np.minimum(same.argmin(axis=1), np.minimum(size, before))
        # a prefix's row is that of the first word that goes on after it
        row = np.zeros((most, n), np.int64)
        node, token = np.zeros((most, n), np.int64), np.full((most, n), WORD_START, np.int64)
        every = np.arange(n)
        for depth in range(1, most):
            longer = size > depth
            own = np.flatnonzero(longer & ((shared < depth) | (before <= depth)))
            if not len(own):
                break
            first = np.zeros(n, np.int64)
            first[own] = own
            row[depth] = np.maximum.accumulate(first)
            node[depth, own] = at = self._steps(node[depth - 1, row[depth - 1, own]], spelled[own, depth - 1])
            token[depth, own] = self._last_tokens(at, own, np.full(len(own), depth), row, token, False)
        parent = node[size - 1, row[size - 1, every]]
        last = self._last_tokens(self._steps(parent, spelled[every, size - 1]), every, size, row, token, True)
        # back from each word's end
        found, count, left, word = [], np.zeros(n, np.int64), size.copy(), every
        while len(word):
            found.append((word, last))
            count[word] += 1
            left[word] -= self.length_array[last]
            word = word[left[word] > 0]
            last = token[left[word], row[left[word], word]]
        ends = np.cumsum(count)
        ids = np.empty(int(ends[-1]) if n else 0, np.uint32)
        for k, (word, last) in enumerate(found):
            ids[ends[word] - 1 - k] = last
        return ids, count

    def _steps(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The automaton's states after a byte each."""
        out, todo, at = np.zeros(len(node), np.int64), np.arange(len(node)), node
        while len(todo):
            key = at << 8 | c[todo]
            place = np.minimum(np.searchsorted(self.child_keys, key), len(self.child_keys) - 1)
            hit = self.child_keys[place] == key
            out[todo[hit]] = self.child_nodes[place[hit]]
            again = ~hit & (at > 0)
            todo, at = todo[again], self.fail_array[at[again]]
        return out

    def _last_tokens(self, node, word, size, row, token, ends: bool) -> np.ndarray:
        """Last token of each prefix (its state, its word, its length) from those of shorter prefixes."""
        near, token_of = self.near[ends]
        out, todo, at = np.empty(len(node), np.int64), np.arange(len(node)), near[node]
        while len(todo):
            last = token_of[at]
            start = size[todo] - self.length_array[last]
            key = token[start, row[start, word[todo]]] << 16 | last
            fit = self._fit(key)
            out[todo[fit]] = last[fit]
            todo, at = todo[~fit], near[self.fail_array[at[~fit]]]
        return out

    def _fit(self, key: np.ndarray) -> np.ndarray:
        slot = _slots(key)
        new = np.unique(key[self.pair_keys[slot] != key])
        if len(new):
            fits = np.array([self.follows(k >> 16, k & 0xFFFF) for k in new.tolist()])
            at = _slots(new)
            self.pair_keys[at], self.pair_fits[at] = new, fits
            out = self.pair_fits[slot]
            missed = np.flatnonzero(self.pair_keys[slot] != key)      # another key took the slot
            out[missed] = [self.follows(k >> 16, k & 0xFFFF) for k in key[missed].tolist()]
            return out
        return self.pair_fits[slot]

    def _step(self, key: int) -> int:
        """The automaton's state after a symbol: the longest suffix that is the beginning of a token."""
        if len(self.steps) > MAX_CACHED_STEPS:
            self.steps.clear()
        child, node, c = self.child, key >> 8, key & 255
        while node and (node << 8 | c) not in child:
            node = self.fail[node]
        self.steps[key] = found = child.get(node << 8 | c, 0)
        return found

    # ---- words of texts ------------------------------------------------------------

    SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3

    def _classes(self) -> None:
        import regex

        kind = np.full(0x300, self.OTHER, np.uint8)
        for cls, pattern in ((self.SPACE, r"\s"), (self.LETTER, r"\p{L}"), (self.DIGIT, r"\p{N}")):
            test = regex.compile(pattern)
            kind[[i for i in range(0x300) if test.match(chr(i))]] = cls
        self.kind = kind

    def odd_words(self, text: str) -> list[bytes]:
        """Words of any text by the library's own normaliser and split; added tokens stand for
        themselves behind a space, which no word has."""
        words: list[bytes] = []
        for part in self.split_added.split(text):
            if part in self.added:
                words.append(b" " + part.encode())
            elif part:
                clean = self.library.normalizer.normalize_str(part)
                words += [self.word_bytes(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]
        return words

    def _word_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of distinct words; new ones go through the trie together."""
        if len(self.young) > MAX_CACHED_WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        fresh = [w for w in words if w not in young]
        if old:
            young.update((w, old[w]) for w in fresh if w in old)
            fresh = [w for w in fresh if w not in young]
        fresh.sort()
        plain = [w for w in fresh if w[0] != 0x20]
        for w in fresh if len(plain) < len(fresh) else ():
            if w[0] == 0x20:
                young[w] = pack("<I", self.added[w[1:].decode()])
        long = [w for w in plain if len(w) > LONG_WORD]
        for w, ids in zip(long, self.walk(long), strict=True):
            young[w] = pack(f"<{len(ids)}I", *ids)
        short = [w for w in plain if len(w) <= LONG_WORD] if long else plain
        if short:
            ids, count = self.walk_together(short)
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
            young.update(zip(short, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        return list(map(young.__getitem__, words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Encode texts together.

        Returns the words' numbers within this call, each text's first word (one entry more than texts), all
        ids, each text's first id (likewise). Texts of common characters are split into words as arrays;
        a text with other characters or with an added token's string goes through the library's normaliser.
        """
        import pandas as pd

        plain: list[str] = []
        odd: dict[int, list[bytes]] = {}
        for i, text in enumerate(texts):
            if "<|" in text and self.split_added.search(text):
                odd[i] = self.odd_words(text)
            elif self.uncommon.search(text):
                odd[i] = self.odd_words(text)
            else:
                plain.append(text.lower())
                continue
            plain.append("")
        codes = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in plain], dtype=np.int64)])
        starts, ends = self._plain_words(codes, offsets)
        hashes = self.poly.ranges(self.code_hash[codes], starts, ends)
        numbers, distinct = pd.factorize(hashes)
        where = np.empty(len(distinct), np.int64)
        where[numbers[::-1]] = np.arange(len(numbers))[::-1]   # first place of each word
        whole = "".join(plain)
        words = [whole[a:b].encode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        encoded = self._word_ids(words)
        first_word = np.searchsorted(starts, offsets)
        if odd:
            pieces, counts = [], np.diff(first_word)
            for i in range(len(texts)):
                if i in odd:
                    known = dict.fromkeys(odd[i])
                    place = dict(zip(known, range(len(encoded), len(encoded) + len(known)), strict=True))
                    encoded += self._word_ids(list(known))
                    got = np.array([place[w] for w in odd[i]], np.int64)
                    counts[i] = len(got)
                else:
                    got = numbers[first_word[i]:first_word[i + 1]]
                pieces.append(got)
            numbers = np.concatenate(pieces).astype(np.int64)
            first_word = np.concatenate([[0], np.cumsum(counts)])
        pool = np.frombuffer(b"".join(encoded), "<u4")
        count = np.fromiter(map(len, encoded), np.int64, len(encoded)) >> 2
        first = np.cumsum(count) - count
        sizes = count[numbers]
        done = np.concatenate([[0], np.cumsum(sizes)])
        ids = pool[np.repeat(first[numbers] - done[:-1], sizes) + np.arange(done[-1])]
        return numbers, first_word, ids, done[first_word]

    def _plain_words(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges: letter runs, single digits, other runs; a lone apostrophe takes the ending
        s, t, m, d, re, ve or ll that follows it."""
        n = len(codes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.kind[codes]
        begin = np.empty(n, bool)
        begin[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begin[1:])
        begin |= kind == self.DIGIT
        cuts = offsets[:-1][offsets[:-1] < n]
        begin[cuts] = True
        lone = np.flatnonzero((codes == 0x27) & begin)
        if len(lone):
            end_of = offsets[np.searchsorted(offsets, lone, "right")]

            def at(k):
                return np.where(lone + k < end_of, codes[np.minimum(lone + k, n - 1)], 0)

            one, two = at(1), at(2)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(lone), bool)
            for pair in ("re", "ve", "ll"):
                long |= (one == ord(pair[0])) & (two == ord(pair[1]))
            for hit, size in ((short, 2), (long & ~short, 3)):
                p = lone[hit]
                begin[p + 1] = False
                after = p + size
                inside = after < end_of[hit]
                begin[after[inside]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        word = kind[starts] != self.SPACE
        return starts[word], ends[word]

    def decode_lists(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Decoded text (UTF-8) of each list of ids; list i is ids[first[i]:first[i + 1]].

        Tokens are joined by a space, as the file names no decoder; special tokens are kept.
        """
        sizes = self.shown_size[ids]
        done = np.concatenate([[0], np.cumsum(sizes)])
        data = self.shown_bytes[np.repeat(self.shown_first[ids] - done[:-1], sizes) + np.arange(done[-1])].tobytes()
        ends = done[first].tolist()
        return [data[a:max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        return self.decode_lists(ids, np.array([0, len(ids)]))[0].decode()


_LOADED: dict[str, WordBPE] = {}


@contextmanager
def loaded(path: str) -> Iterator[WordBPE]:
    """The encoder of a vocabulary file, once per Python worker; the words met go when the task ends, so
    that a reused worker takes none into other work."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    try:
        yield _LOADED[path]
    finally:
        _LOADED[path].reset()
        give_back()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
