"""Byte-pair encoding as a streaming transducer, and decoding as an incremental byte-to-text machine.

A token sequence is the encoding of a word exactly if each token and each adjacent pair of tokens survives encoding on
its own. So the encoder keeps, for each of the last positions only, the one token with which an encoding of the prefix
can end. Tokens are stable, and emitted, where the chains of all live positions have met. `lookahead()` is the bound on how far they can
stay apart that follows from the merge list (number of merges times longest token, for lists in which both parts of a
merge are made by earlier merges; such lists are the only ones taken); the encoder holds no more than that and fails if it had to; `buffered` is
the largest distance met so far. A document is read in pieces that end before a space, words are encoded one by one, ids go to the hash and
to the decoder in blocks. So beyond the row's own text memory depends on the merge list, and not on the text's or a word's length.

Decoding feeds ids to a machine that turns their bytes into text as soon as a character is whole. As its state is empty between words, the
text of a word's ids is kept with the word.

Defined results: null text counts as empty and has no tokens, n_tokens 0 and the hash of the empty string. Rows are
treated alone, so repeated rows repeat their result, and an empty table gives no rows. Strings of special tokens in the text give the special ids,
as in the tokenizers library. Of merges that could make the same token, the first in the list does. Extra columns are dropped unless in `keep`.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces

#: White space of Unicode, as the vocabulary file's normaliser sees it. Fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The printable letter for each byte value that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(extra)
            extra += 1
    return letters


#: Where a document may be cut; words longer than `LONG` are not kept.
BREAK, LONG = re.compile(r"[ \n]"), 64
#: Lengths of word beginnings whose states are kept for other words; all are shorter than any span of live positions, and than 16.
SHARED = (12, 8, 5)
#: In a kept state: no token ends here.
NONE = 0xFFFFFFFF


class Encoder:
    """Encodes symbol sequences. `parts[id]`: what the token is merged from; `made[id]`: rank of that merge, -1 for symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for k, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if max(self.made.get(left, -1), self.made.get(right, -1)) >= k:
                raise ValueError("a merge uses a token that only a later merge makes")
            self.rank[left, right] = k
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = (left, right), k
        self.most = max((self._size(t) for t in vocab), default=1)
        self.own: dict[int, bool] = {t: True for t in vocab.values() if t not in self.parts}
        for t in sorted(self.parts, key=self.made.get):
            self.own[t] = self._stands(t)
        self.usable = {k: t for k, t in vocab.items() if self.own[t]}
        self.by_pair = {a << 20 | b: k for (a, b), k in self.rank.items()}
        self.left_edge = {t: self._spine(t, 0) for t in self.usable.values()}
        self.right_edge = {t: self._spine(t, 1) for t in self.usable.values()}
        # by position from 1 on: the token that ends there, shifted by 4, and where it starts
        self.begun: dict[str, array] = {}
        self.buffered, self.bound = 0, self.lookahead()

    def _size(self, token: str) -> int:
        return len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix) else 0)

    def lookahead(self) -> int:
        return max(1, len(self.rank)) * self.most

    def _spine(self, token: int, side: int) -> tuple[tuple[int, int, float], ...]:
        """The tokens at one edge while `token` is built, each with the ranks at which it is made and at which it grows further."""
        found, until = [], float("inf")
        while True:
            found.append((token, self.made.get(token, -1), until))
            if token not in self.parts:
                return tuple(found)
            until, token = self.made[token], self.parts[token][side]

    def joins(self, a: int, b: int) -> bool:
        """Whether `a` and `b` stay apart when their symbols are encoded together."""
        rank, right = self.by_pair, self.left_edge[b]
        for x, x_from, x_until in self.right_edge[a]:
            x <<= 20
            for y, y_from, y_until in right:
                r = rank.get(x | y)
                if r is not None and x_from < r < x_until and y_from < r <= y_until:
                    return False
        return True

    def _stands(self, token: int) -> bool:
        """Whether the token is the encoding of its own symbols; its parts are known to be."""
        a, b = self.parts[token]
        if not (self.own[a] and self.own[b]):
            return False
        r, right = self.made[token], self._spine(b, 0)
        for x, x_from, x_until in self._spine(a, 1):
            for y, y_from, y_until in right:
                q = self.rank.get((x, y))
                if q is not None and (x, y) != (a, b) and max(x_from, y_from) < q < r and q < x_until and q <= y_until:
                    return False
        return True

    def encode(self, word: str) -> Iterator[int]:
        """Tokens of one word, given as the letters of its bytes; its last letter carries the suffix."""
        get, n, most, tail = self.usable.get, len(word), self.most, self.suffix
        rank, left_edge, right_edge = self.by_pair.get, self.left_edge, self.right_edge
        last: dict[int, tuple[int, int]] = {}  # position: token that ends there, where it starts
        done = begun = 0
        for p in SHARED:
            if p < n and (known := self.begun.get(word[:p])) is not None:
                last, begun = {k: (x >> 4, x & 15) for k, x in enumerate(known, 1) if x != NONE}, p
                break
        for i in range(begun + 1, n + 1):
            end = tail if i == n else ""
            for j in range(i - most if i > most else 0, i):
                t = get(word[j:i] + end)
                if t is None:
                    continue
                if j:
                    if j not in last:
                        continue
                    apart, right = True, left_edge[t]  # joins(), in line
                    for x, x_from, x_until in right_edge[last[j][0]]:
                        x <<= 20
                        for y, y_from, y_until in right:
                            r = rank(x | y)
                            if r is not None and x_from < r < x_until and y_from < r <= y_until:
                                apart = False
                                break
                        if not apart:
                            break
                    if not apart:
                        continue
                last[i] = t, j
                break
            if i in SHARED and i < n:
                if len(self.begun) >= 60_000:
                    self.begun.clear()
                self.begun[word[:i]] = array("I", [last[k][0] << 4 | last[k][1] if k in last else NONE for k in range(1, i + 1)])
            if i - done >= 4 * most and i % most == 0 and i < n:
                live = {p for p in range(i - most + 1, i + 1) if p in last}
                while len(live) > 1:
                    top = max(live)
                    live.remove(top)
                    live.add(max(last[top][1], done))
                meet = live.pop()
                self.buffered = max(self.buffered, i - meet)
                if i - meet > self.bound + most:
                    raise RuntimeError("live positions stay apart for longer than the merge list allows")
                if meet > done:
                    yield from self._chain(last, done, meet)
                    last = {p: v for p, v in last.items() if p >= meet}
                    done = meet
        if n:
            yield from self._chain(last, done, n)

    @staticmethod
    def _chain(last: dict[int, tuple[int, int]], start: int, end: int) -> list[int]:
        out = []
        while end > start:
            token, end = last[end]
            out.append(token)
        return out[::-1]


class Decoder:
    """Ids to text, one by one: a token's bytes go through an incremental machine, which gives text as soon as a character is whole.

    `plain` decodes to words: letters stand for bytes, the suffix for a space. Without it the text is the library's for a file without a
    decoder: the tokens' own strings, with spaces between; ids that the vocabulary lacks give nothing."""

    def __init__(self, tokens: dict[int, str], suffix: str, plain: bool = True):
        value = {c: b for b, c in enumerate(byte_letters())}
        self.bytes, self.plain, self.begun = {}, plain, False
        for k, t in tokens.items():
            if not plain:
                self.bytes[k] = t.encode("utf-8", "surrogatepass")
                continue
            ends = suffix and t.endswith(suffix)
            body = t[: -len(suffix)] if ends else t
            self.bytes[k] = (bytes(value[c] for c in body) if all(c in value for c in body) else body.encode()) + (b" " if ends else b"")
        self.machine = codecs.getincrementaldecoder("utf-8")("replace" if plain else "surrogatepass")

    def feed(self, token: int) -> str:
        raw = self.bytes.get(token)
        if raw is None:
            return ""
        glue = b" " if self.begun and not self.plain else b""
        self.begun = True
        return self.machine.decode(glue + raw)

    def close(self) -> str:
        """What is left; the machine starts anew."""
        out = self.machine.decode(b"", True)
        self.machine.reset()
        self.begun = False
        return out

    def all(self, ids) -> str:
        return "".join([self.feed(i) for i in ids]) + self.close()


#: Characters of a document that are normalised and split at once; tokens that are hashed at once.
PIECE, BLOCK = 1 << 16, 4096


class WordBpe:
    """The whole path of a word-level vocabulary file: special strings, NFC, spaces, lower case, split, bytes, merges.

    `library_text` decodes as the library does for a file without a decoder (token strings with spaces between);
    `text` decodes to plain words."""

    def __init__(self, path: str, cache: int = 300_000, cache_bytes: int = 40 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.encoder = Encoder(model["vocab"], merges, self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.string = {v: k for k, v in (model["vocab"] | self.special).items()}
        self.letters = byte_letters()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # white space only parts words, so runs of it need no replacement first
        self.words = regex.compile(pattern.replace(r"\s", SPACE))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # ids of words, packed: a worker holds two of these beside its executor, of at most so many words and so many bytes of words and ids
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit, self.limit_bytes, self.held = cache, cache_bytes, 0
        top = max(self.string) + 1
        self.packed = "H" if top <= 1 << 16 else "I"
        self.id_bytes = [b"%d" % k for k in range(top)]
        self.string_bytes = [self.string.get(k, "").encode("utf-8", "surrogatepass") for k in range(top)]
        self.decoder, self.plain = Decoder(self.string, self.suffix, plain=False), Decoder(self.string, self.suffix)

    def word_ids(self, word: str) -> Iterator[int]:
        return self.encoder.encode(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters))

    def _flat(self, part: str) -> Iterator[str]:
        """The normalised text in pieces. They end before a space or line end, where neither normal forms nor words reach across."""
        start = 0
        while start < len(part):
            end = start + PIECE
            if end < len(part):
                found = BREAK.search(part, end)
                end = found.start() if found else len(part)
            yield unicodedata.normalize("NFC", part[start:end]).replace("Σ", "σ").lower()
            start = end

    def parts(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """(are special strings, strings): special strings as they stand, and the words between them, some thousands at once."""
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                yield True, [part]
            elif part:
                for flat in self._flat(part):
                    yield False, self.words.findall(flat)

    def ids(self, text: str) -> Iterator[int]:
        for special, words in self.parts(text):
            for w in words:
                if special:
                    yield self.special[w]
                else:
                    yield from self.word_ids(w)

    def library_text(self, ids) -> str:
        return self.decoder.all(ids)

    def text(self, ids) -> str:
        return self.plain.all(ids)

    def _known(self, special: bool, word: str) -> bytes:
        """Packed ids of a word of up to `LONG` characters, or of a special string."""
        found = self.cache.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = array(self.packed, [self.special[word]] if special else self.word_ids(word)).tobytes()
            if len(self.cache) >= self.limit or self.held >= self.limit_bytes:
                self.old, self.cache, self.held = self.cache, {}, 0
            self.cache[word] = found
            self.held += sys.getsizeof(word) + sys.getsizeof(found)
        return found

    def _blocks(self, text: str) -> Iterator[array | list[int]]:
        """The text's ids, some thousands at once; those of a longer word in blocks of their own."""
        known = self._known
        for special, words in self.parts(text):
            get = self.cache.get
            for k in range(0, len(words), BLOCK):
                got = []
                for w in words[k : k + BLOCK]:
                    x = get(w)
                    if x is None:
                        if len(w) > LONG and not special:
                            # what stands before it goes first
                            yield array(self.packed, b"".join(got))
                            got, ids = [], self.word_ids(w)
                            while some := list(itertools.islice(ids, BLOCK)):
                                yield some
                            continue
                        x = known(special, w)
                        get = self.cache.get
                    got.append(x)
                yield array(self.packed, b"".join(got))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, hash of the ids, hash of the decoded text (as `library_text` has it); hashes are fed in blocks."""
        n, a, b, glue, number, string = 0, hashlib.sha256(), hashlib.sha256(), b"", self.id_bytes, self.string_bytes
        for ids in self._blocks(text):
            if ids:
                a.update(glue + b" ".join([number[i] for i in ids]))
                b.update(glue + b" ".join([string[i] for i in ids]))
                n, glue = n + len(ids), b" "
        return n, a.hexdigest(), b.hexdigest()


_tools: dict[str, WordBpe] = {}


def _tool(path: str) -> WordBpe:
    """One for each worker process, with its cache of words."""
    if path not in _tools:
        _tools[path] = WordBpe(path)
    return _tools[path]


def encode_documents(docs: DataFrame, path: str, keep: list[str], text: str = "text", with_ids: bool = False) -> DataFrame:
    """Columns `keep` and n_tokens, ids_sha256, decoded_sha256; with `with_ids` also the ids and the decoded text."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    more = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches):
        tool = _tool(path)
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column("cw_text").to_pylist()]
            found = [tool.digest(t) for t in texts]
            cols = [batch.column(c) for c in keep] + [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ids = [list(tool.ids(t)) for t in texts]
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array([tool.library_text(x) for x in ids], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(*keep, docs[text].alias("cw_text")).mapInArrow(run, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
