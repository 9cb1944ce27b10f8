"""Streaming byte-pair encoding and decoding.

Encoding is a left-to-right transducer over symbols. A token sequence is what the merge list
makes of a string exactly if every neighbouring pair of it is what the list makes of that
pair's own string. So each prefix of a word has one last token, found from the ends of earlier
prefixes. An end stays open only while the symbols since it are the beginning of a vocabulary
token; tokens that all open ends share can no longer change. Open ends lie within the longest
token less one symbol: that is the merge list's sufficient lookahead (`Merges.lookahead`), and
the only memory that a word of any length needs.

The transducer runs in two ways with the same outcome. `Merges.lockstep` moves many words at once,
symbol by symbol: the trie, the ranks and the checked pairs are flat tables, and an open end is a
row of numbers. `Encoder.stream` takes one word of any length and emits its tokens once they are
stable. Words of up to LONGEST bytes go the first way, each different word of a group of texts
once, and stay in a memo of bounded size; longer ones go the second.

Whether two tokens stay apart (`Merges.apart`) follows from their merge trees: going back in time
along the right edge of one and the left edge of the other, no merge across the border may come
before the merge that takes either neighbour away.

Decoding is a state machine over bytes that keeps at most three bytes of an unfinished UTF-8
sequence. The tokenizers library's decode, for a file without a decoder, gives the vocabulary's
strings joined by spaces; the same machine gives that text from the strings' bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import claim_memo, give_back, task_memo

#: Words in the memo; their longest; characters encoded at a time; slots of the table of checked pairs.
WORDS, LONGEST, GROUP, PAIR_BITS = 150_000, 128, 1 << 19, 18
NEVER = 1 << 40
#: White space, and ASCII characters that some programs take for it.
GAP, ODD_ASCII = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"), re.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Table:
    """Whole numbers by whole-number keys, looked up for many keys at once; -1 for unknown ones."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        slot, left = _slot(keys, self.bits), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = keys[free[first]], values[free[first]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (size - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = _slot(keys, self.bits)
        found, out = self.keys[slot], self.values[slot]
        out[found < 0] = -1
        left = np.flatnonzero((found != keys) & (found >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            out[left] = np.where(found < 0, -1, self.values[slot])
            on = (found != keys[left]) & (found >= 0)
            left, slot = left[on], slot[on]
        return out


class Merges:
    """Vocabulary and merge ranks over symbols: 0-255 a byte, 256-511 a byte that ends a word."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        chars = {c: b for b, c in enumerate(byte_symbols())}
        self.strings = {i: s for s, i in vocab.items()}
        self.suffix, self.size = suffix, max(vocab.values(), default=0) + 1

        def symbols(token: str) -> tuple[int, ...] | None:
            ends = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
            body = token.removesuffix(suffix) if ends else token
            if not body or any(c not in chars for c in body):
                return None
            out = [chars[c] for c in body]
            if ends:
                out[-1] += 256
            return tuple(out)

        self.spelled = {i: s for t, i in vocab.items() if (s := symbols(t)) is not None}
        self.base = {s[0]: i for i, s in self.spelled.items() if len(s) == 1}
        self.born = np.full(self.size, -1, np.int64)
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        made_by, keys = [], []
        for n, pair in enumerate(merges):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ", 1)
            if a + b in vocab:
                x, y, made = vocab[a], vocab[b], vocab[a + b]
                if max(self.born[x], self.born[y]) >= n or self.born[made] >= 0:
                    raise ValueError("merges are not in the order in which they make their tokens")
                self.born[made], self.left[made], self.right[made] = n, x, y
                made_by.append(made)
                keys.append(x << 20 | y)
        self.made_by = np.array(made_by, np.int64)
        self.ranks = Table(np.array(keys, np.int64), self.born[self.made_by])
        made = np.flatnonzero(self.born >= 0)
        whole = np.zeros(self.size, bool)
        whole[list(self.base.values())] = True
        whole[made] = self.apart(self.left[made], self.right[made], self.born[made])
        for i in made[np.argsort(self.born[made])].tolist():  # a token of tokens that the list never makes
            whole[i] &= whole[self.left[i]] and whole[self.right[i]]
        self.children: dict[int, int] = {}
        token = [-1]
        for i, s in self.spelled.items():
            if whole[i]:
                node = 0
                for x in s:
                    key = node << 9 | x
                    node = self.children.get(key, -1)
                    if node < 0:
                        node = self.children[key] = len(token)
                        token.append(-1)
                token[node] = i
        self.trie = Table(np.array(list(self.children), np.int64), np.array(list(self.children.values()), np.int64))
        self.token, self.more = np.array(token, np.int32), np.zeros(len(token), bool)
        self.more[np.array(list(self.children), np.int64) >> 9] = True
        self.token_of, self.has_more = token, self.more.tolist()
        self.lookahead = max((len(s) for i, s in self.spelled.items() if whole[i]), default=1) - 1
        self.numbers = list(range(self.size))  # one object for each id, which all words' tokens share
        self._checked: dict[int, bool] = {}
        self._keys, self._apart = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def plain(self, symbols: Iterable[int]) -> list[int]:
        """Merging by the definition: the lowest-ranked pair first, the leftmost of equals."""
        ids = [self.base[x] for x in symbols]
        while len(ids) > 1:
            ranks = self.ranks.get(np.array(ids[:-1], np.int64) << 20 | np.array(ids[1:], np.int64))
            if (ranks < 0).all():
                break
            i = int(np.where(ranks < 0, NEVER, ranks.astype(np.int64)).argmin())
            ids[i : i + 2] = [int(self.made_by[np.searchsorted(self.born[self.made_by], ranks[i])])]
        return ids

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge joins a and b (before the merge `until`), each being made by its own merges."""
        out, at = np.ones(len(a), bool), np.arange(len(a))
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        gone_x = np.full(len(a), NEVER, np.int64) if until is None else np.array(until, np.int64)
        gone_y = gone_x - (until is not None)
        while len(at):
            r = self.ranks.get(x << 20 | y)
            joined = (r >= 0) & (r < gone_x) & (r <= gone_y)
            out[at[joined]] = False
            on = ~joined & ((self.born[x] >= 0) | (self.born[y] >= 0))
            at, x, y, gone_x, gone_y = at[on], x[on], y[on], gone_x[on], gone_y[on]
            back_y = self.born[y] >= self.born[x]  # of equal merges the left one came first
            gone_y, gone_x = np.where(back_y, self.born[y], gone_y), np.where(back_y, gone_x, self.born[x])
            x, y = np.where(back_y, x, self.right[x]), np.where(back_y, self.left[y], y)
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """apart, through a table of fixed size; what it does not hold is worked out anew."""
        keys = a.astype(np.int64) << 20 | b
        slot = _slot(keys, PAIR_BITS)
        out, new = self._apart[slot], np.flatnonzero(self._keys[slot] != keys)
        if len(new):
            out[new] = self.apart(a[new], b[new])
            self._keys[slot[new]], self._apart[slot[new]] = keys[new], out[new]
            twice = self._keys[slot[new]] != keys[new]  # another key of this call took the slot
            if twice.any():
                self._keys[slot[new[twice]]] = -1
        return out

    def pair(self, a: int, b: int) -> bool:
        """apart for one pair, by a memo of bounded size."""
        key = a << 20 | b
        known = self._checked.get(key)
        if known is None:
            if len(self._checked) >= 1 << 16:
                self._checked.clear()
            known = self._checked[key] = bool(self.pairs(np.array([a]), np.array([b]))[0])
        return known

    def lockstep(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The tokens of each word: the transducer over all words, symbol by symbol."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        sizes, width = sizes[order], int(sizes.max(initial=0))
        symbols = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in order]), np.uint8).reshape(len(words), width).astype(np.int64)
        if self.suffix and width:
            full = np.flatnonzero(sizes)
            symbols[full, sizes[full] - 1] |= 256
        last = np.full((len(words), width + 1), -1, np.int32)
        start_of = np.zeros((len(words), width + 1), np.int16)
        own, node, start = (np.zeros(0, np.int64) for _ in range(3))
        for i in range(width):
            m = int(np.searchsorted(-sizes, -i))  # words with a symbol here
            on = own < m
            own = np.concatenate([own[on], np.arange(m)])
            node = np.concatenate([node[on], np.zeros(m, np.int64)])
            start = np.concatenate([start[on], np.full(m, i)])
            node = self.trie.get(node << 9 | symbols[own, i]).astype(np.int64)
            on = node >= 0
            own, node, start = own[on], node[on], start[on]
            found = self.token[node]
            c = np.flatnonzero(found >= 0)
            before = last[own[c], start[c]]
            follows = start[c] == 0
            later = np.flatnonzero(~follows)
            follows[later] = self.pairs(before[later], found[c[later]])
            c = c[follows][::-1]  # the oldest end is written last and stays
            last[own[c], i + 1], start_of[own[c], i + 1] = found[c], start[c]
            if (last[:m, i + 1] < 0).any():
                raise ValueError("a symbol has no token")
            on = self.more[node]
            own, node, start = own[on], node[on], start[on]
        rows, at, n = np.flatnonzero(sizes), sizes[sizes > 0], np.zeros(len(words), np.int64)
        back = np.zeros((len(words), width), np.int32)
        while len(rows):
            back[rows, n[rows]] = last[rows, at]
            n[rows] += 1
            at = start_of[rows, at]
            on = at > 0
            rows, at = rows[on], at[on]
        out: list[tuple[int, ...]] = [()] * len(words)
        for i, k, ids in zip(order.tolist(), n.tolist(), back.tolist()):
            out[i] = tuple(map(self.numbers.__getitem__, ids[k - 1 :: -1])) if k else ()
        return out


class Encoder:
    """The transducer for one word of any length. Open ends, oldest first: (trie node of the symbols
    since that end, tokens before it that are not yet emitted, the first of them the last one emitted or -1)."""

    def __init__(self, merges: Merges):
        self.merges = merges

    def step(self, ends: list[tuple[int, tuple]], symbol: int) -> tuple[list[tuple[int, tuple]], tuple[int, ...]]:
        """The open ends after a symbol, and the tokens that became stable."""
        merges, out, here = self.merges, [], None
        for node, tokens in ends:
            node = merges.children.get(node << 9 | symbol, -1)
            if node < 0:
                continue
            token = merges.token_of[node]
            if token >= 0 and here is None:
                last = tokens[-1]
                if last < 0 or merges.pair(last, token):
                    here = tokens + (token,)
            if merges.has_more[node]:
                out.append((node, tokens))
        if here is None:
            raise ValueError("a symbol has no token")
        out.append((0, here))
        shared = 1
        while all(len(t) > shared and t[shared] == here[shared] for _, t in out):
            shared += 1
        return [(n, t[shared - 1 :]) for n, t in out], here[1:shared]

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of one word, each as soon as it is stable."""
        ends: list[tuple[int, tuple]] = [(0, (-1,))]
        for x in symbols:
            ends, stable = self.step(ends, x)
            yield from stable
        yield from ends[-1][1][1:]

    def word(self, data: bytes) -> tuple[int, ...]:
        return tuple(self.stream((*data[:-1], data[-1] + 256) if self.merges.suffix else data))


class Decoder:
    """Ids to text, some at a time, keeping the bytes of an unfinished character only.

    pieces: the bytes that each id stands for; gap: bytes between two ids."""

    def __init__(self, pieces: list[bytes], gap: bytes = b""):
        self.pieces, self.gap, self.rest, self.begun = pieces, gap, b"", False

    def feed(self, ids: list[int]) -> str:
        """The text that these ids complete."""
        if not ids:
            return ""
        data = self.rest + (self.gap if self.begun else b"") + self.gap.join(map(self.pieces.__getitem__, ids))
        self.begun, keep = True, 0
        for back in range(1, min(4, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                need = 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 1
                keep = back if need > back else 0
                break
        self.rest = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def unsettled() -> np.ndarray:
    """For every code point whether the Unicode tables of different programs may differ on its class,
    case or place in NFC: one that was not assigned, or of another class, in Unicode 3.2, one with a combining
    class, and the separators U+001C to U+001F."""
    old = unicodedata.ucd_3_2_0
    out = np.zeros(0x110000, bool)
    out[0x1C:0x20] = True
    for x in range(0x80, 0x110000):
        c = chr(x)
        was = old.category(c)
        out[x] = was == "Cn" or was[0] != unicodedata.category(c)[0] or unicodedata.combining(c) > 0
    return out


class Tokenizer:
    """A tokenizers file of the kind: NFC, white space to one space, lower case; split by a
    pattern; byte-level BPE with word ends.

    Words are found with this process's own Unicode tables where all versions agree on them, and by
    the library's normaliser and pattern in stretches where they may not (`unsettled`)."""

    def __init__(self, path: str, words: int = WORDS):
        import tokenizers

        self.most_words = words
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special_ids = {s: i for i, s in self.special.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special_ids, key=len, reverse=True)))) if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        bare = spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
        self.normalizer = tokenizers.Tokenizer.from_str(json.dumps(bare)).normalizer
        self.splitter = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
        self.encoder = Encoder(self.merges)
        strings, spelled, suffix = self.merges.strings, self.merges.spelled, self.merges.suffix
        ids = range(max(*strings, *self.special) + 1)
        self.id_text = [str(i) for i in ids]
        self.library_bytes = [(self.special.get(i) or strings.get(i, "")).encode() for i in ids]
        self.own_bytes = [self.special[i].encode() if i in self.special else bytes(x & 255 for x in spelled.get(i, ())) + (b" " if suffix and i in spelled and spelled[i][-1] > 255 else b"") for i in ids]
        strings.clear()
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def normal(self, text: str) -> str:
        """Lower case is taken character by character, so a final sigma is as any other."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def _settled(self, text: str) -> list[str]:
        return self.pattern.findall(self.normal(text)) if text else []

    def split(self, text: str) -> list[str]:
        """The words of a stretch without special tokens."""
        if text.isascii():
            if not ODD_ASCII.search(text):
                return self.pattern.findall(text.lower())
            odd = [m.start() for m in ODD_ASCII.finditer(text)]
        else:
            odd = np.flatnonzero(unsettled()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]).tolist()
        out, at = [], 0
        for place in odd:
            if place < at:
                continue
            start = place
            while start > at and not GAP.match(text[start - 1]):
                start -= 1
            gap = GAP.search(text, place)
            end = gap.start() if gap else len(text)
            out += self._settled(text[at:start])
            out += [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text[start:end]))]
            at = end
        return out + self._settled(text[at:]) if at else self._settled(text)

    def words(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens, in order."""
        if not (self.cut and "<|" in text):
            return self.split(text)
        out: list[str | int] = []
        at = 0
        for m in self.cut.finditer(text):
            out += self.split(text[at : m.start()])
            out.append(self.special_ids[m.group()])
            at = m.end()
        return out + self.split(text[at:])

    def pieces(self, text: str) -> Iterator[str]:
        """text cut before white space into stretches of bounded length where it has any."""
        at = 0
        while len(text) - at > GROUP:
            m = GAP.search(text, at + GROUP)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def _learn(self, words: set) -> None:
        """Put new words into the memo; special ids stand for themselves."""
        older, new = self.older, []
        if len(self.known) >= self.most_words:  # two generations: words in use stay
            older, self.known = self.known, {}
        for w in words:
            found = older.get(w)
            if found is not None:
                self.known[w] = found
            elif isinstance(w, int):
                self.known[w] = (w,)
            else:
                new.append(w)
        self.older = older
        data = [w.encode("utf-8", "surrogatepass") for w in new]
        short = [i for i, d in enumerate(data) if len(d) <= LONGEST]
        self.known.update(zip([new[i] for i in short], self.merges.lockstep([data[i] for i in short])))

    def _ids(self, word) -> tuple[int, ...]:
        """Of a word that the memo does not take."""
        return self.encoder.word(word.encode("utf-8", "surrogatepass"))

    def encoded(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[tuple[int, ...]]]]:
        """(number of the text, ids of each word) for every text's pieces, in order; texts are taken in groups of
        about GROUP characters, in which each different word is encoded once."""
        held: list[tuple[int, list]] = []
        size = 0

        def flushed():
            get, words = self.known.get, set().union(*(w for _, w in held))
            self._learn({w for w in words if w not in self.known})
            for n, own in held:
                try:
                    yield n, list(map(self.known.__getitem__, own))
                except KeyError:
                    yield n, [found if (found := get(w)) is not None else self._ids(w) for w in own]

        for n, text in enumerate(texts):
            for piece in self.pieces(text or ""):
                held.append((n, self.words(piece)))
                size += len(piece)
                if size >= GROUP:
                    yield from flushed()
                    held, size = [], 0
        if held:
            yield from flushed()

    def all_ids(self, texts: list[str | None]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        for n, words in self.encoded(texts):
            out[n] += chain.from_iterable(words)
        return out

    def ids(self, text: str | None) -> list[int]:
        return self.all_ids([text])[0]

    def counts(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        for n, words in self.encoded(texts):
            out[n] += sum(map(len, words))
        return out

    def library_decoder(self) -> Decoder:
        """Gives what the library's decode gives."""
        return Decoder(self.library_bytes, b" ")

    def decoder(self) -> Decoder:
        """Gives the normalised text back, a space after each word."""
        return Decoder(self.own_bytes)

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str, str]]:
        """(ids, SHA-256 of the ids joined by spaces, SHA-256 of the text that the library decodes, SHA-256 of
        the words decoded)."""
        out: list[tuple[int, str, str, str]] = []
        now, state = -1, None

        def close():
            for decoder, digest in zip(state[1], state[3]):
                digest.update(decoder.finish().encode())
            out.append((state[0], state[2].hexdigest(), *(d.hexdigest() for d in state[3])))

        for n, words in self.encoded(texts):
            if n != now:
                if state:
                    close()
                now, state = n, [0, (self.library_decoder(), self.decoder()), hashlib.sha256(), (hashlib.sha256(), hashlib.sha256())]
            ids = list(chain.from_iterable(words))
            if ids:
                state[2].update(((" " if state[0] else "") + " ".join(map(self.id_text.__getitem__, ids))).encode())
                state[0] += len(ids)
                for decoder, digest in zip(state[1], state[3]):
                    digest.update(decoder.feed(ids).encode())
        if state:
            close()
        return out


@lru_cache(maxsize=1)
def _loaded(path: str) -> Tokenizer:
    own = Tokenizer(path)
    give_back()
    return own


def tokenizer(path: str) -> Tokenizer:
    """One per Python worker; its memo lasts for a task."""
    own = _loaded(path)
    claim_memo("bpe", own.forget)
    return own


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, words_sha256 of every whole text.

    decoded_sha256 is of the text that the library's decode gives, words_sha256 of the words that
    the ids stand for, a space after each; both come out of the byte state machine. A null text is the
    empty one: no tokens and the digest of nothing. Rows may repeat and each gives a row; an empty
    table gives none; extra columns are ignored."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            found = tokenizer(path).digests(batch.column(1).to_pylist())
            columns = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "words_sha256"])

    return docs.select("doc_id", "text").mapInArrow(task_memo(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, words_sha256 string")


def encode_column(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs' doc_id with its token ids and the words decoded from them by the byte state machine."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            own = tokenizer(path)
            ids = own.all_ids(batch.column(1).to_pylist())
            texts = []
            for found in ids:
                decoder = own.decoder()
                texts.append(decoder.feed(found) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(task_memo(run), "doc_id long, ids array<int>, decoded string")
