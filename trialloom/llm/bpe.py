"""Byte-pair encoding and decoding by a walk over a trie of distinct words.

In a byte-pair encoding every prefix of a word has exactly one *last token*: the one whose neighbour, the last token
of what stands before it, stays apart from it when the two strings are encoded together. The last tokens of all
prefixes are thus found from left to right, and depend on the prefix alone. New distinct words are sorted and put into
a trie, so that nodes are made depth first; a node's last token is found once and serves every word that goes through
it. The encoding of a word is read off backwards from its last node.

Words end in symbols of their own (a character with the end-of-word suffix), which are letters of the trie like others.
The tokenizer is read, never trained; its file is a parameter and reaches the tasks as a broadcast of its fixed size.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.text import map_texts

#: What one task remembers: nodes of the trie, words with their encodings, and the symbols of all these words. All are
#: emptied when one is full.
MAX_NODES, MAX_WORDS, MAX_SYMBOLS = 600_000, 200_000, 4_000_000
#: Characters of texts whose words are looked up together.
BLOCK_CHARS = 1_000_000
#: Longer words are walked on their own; a trie would hold them for no second reader.
LONG_WORD = 2_000
#: Characters outside these ranges may be newer than the tables of one of the two libraries: such texts are normalised
#: and cut into words by the tokenizer's own rules.
_UNSURE = regex.compile(r"[^\x00-ԯ‐-⁤、-鿿가-힣]")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next free character from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


#: A symbol that ends a word is its character moved up by this much.
_END = 0x1000


class Vocabulary:
    """Tokens of a byte-level BPE file as strings of symbols, one character each, and how each is made of two others."""

    def __init__(self, source: str) -> None:
        self.source = source
        spec = json.loads(source)
        model = spec["model"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or spec.get("post_processor") or spec.get("decoder"):
            raise ValueError("only byte-level BPE files without dropout, unknown token, fallback, post-processor and decoder are read")
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must be plain strings")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in added}
        self.text = {**{i: t for t, i in model["vocab"].items()}, **{i: t for t, i in self.added.items()}}
        self.id_of = {self._symbols(t): i for t, i in model["vocab"].items()}
        self.size = {i: len(s) for s, i in self.id_of.items()}
        #: Every end of every token with the token it is, or -1: what no token ends in is known after a few symbols.
        self.ends = {s[k:]: -1 for s in self.id_of for k in range(len(s))} | self.id_of
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right = model["vocab"][a], model["vocab"][b]
            made = model["vocab"][a + b]
            late = max(self.parts.get(left, (-1,))[0], self.parts.get(right, (-1,))[0])
            if made in self.parts or late >= rank:
                raise ValueError("a token has two derivations, or one from a later merge")
            self.rank[left, right] = rank
            self.parts[made] = (rank, left, right)
        self.cut_words = self._pattern(spec)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def _symbols(self, token: str) -> str:
        """A token with one character for each symbol."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + _END)
        return token

    @staticmethod
    def _pattern(spec: dict) -> regex.Pattern:
        """The split pattern, if the text goes through the one chain of normalisers and cutters that is rebuilt here."""
        norm = (spec.get("normalizer") or {}).get("normalizers", [])
        cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = (
            [n["type"] for n in norm] == ["NFC", "Replace", "Lowercase"]
            and (norm[1]["pattern"], norm[1]["content"]) == ({"Regex": r"\s+"}, " ")
            and [c["type"] for c in cut] == ["Split", "ByteLevel"]
            and (cut[0]["behavior"], cut[0]["invert"]) == ("Removed", True)
            and not cut[1]["add_prefix_space"]
            and not cut[1]["use_regex"]
        )
        if not known:
            raise ValueError("another chain of normalisers and cutters")
        return regex.compile(cut[0]["pattern"]["Regex"])

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay two tokens when their strings are encoded as one.

        Played backwards: the later-made of the two tokens at the border is taken apart, until both are symbols. They
        grow together if a merge of the two at the border comes before either is used up by its own neighbour; of
        equal merges the one further left comes first.
        """
        rank, parts = self.rank, self.parts
        used_left = used_right = len(rank)
        while True:
            r = rank.get((left, right))
            if r is not None and r < used_left and r <= used_right:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                used_left, left = a[0], a[2]
            else:
                used_right, right = b[0], b[1]

    def merged(self, symbols: str) -> list[int]:
        """A string encoded by its merges in order of rank; for short strings only."""
        found = [self.id_of[c] for c in symbols]
        while len(found) > 1:
            at = min(range(len(found) - 1), key=lambda i: self.rank.get((found[i], found[i + 1]), len(self.rank)))
            if (found[at], found[at + 1]) not in self.rank:
                break
            found[at : at + 2] = [self.id_of[self._joined(found[at], found[at + 1])]]
        return found

    def _joined(self, a: int, b: int) -> str:
        return self._symbols(self.text[a] + self.text[b])


class TrieEncoder:
    """Encodes texts; keeps a trie of the words seen so far."""

    def __init__(self, source: str) -> None:
        self.vocabulary = Vocabulary(source)
        self.byte_chars = _byte_chars()
        self.stay: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.library = None
        self.empty()

    def empty(self) -> None:
        self.child: dict[int, int] = {}
        self.last: list[int] = [-1]
        self.ids: dict[str, tuple[int, ...]] = {}
        self.symbols = 0

    # words -------------------------------------------------------------------------------------------------------
    def _last_token(self, symbols: str, n: int, before: list[int]) -> int:
        """The last token of the first ``n`` symbols, given the last tokens of all shorter prefixes."""
        v, stay = self.vocabulary, self.stay
        find, found = v.ends.get, []
        for at in range(n - 1, -1, -1):
            token = find(symbols[at:n])
            if token is None:
                break
            if token >= 0:
                found.append((at, token))
        for at, token in reversed(found):
            if at == 0:
                good = self.whole.get(token)
                if good is None:
                    good = self.whole[token] = v.merged(symbols[:n]) == [token]
            else:
                pair = (before[at], token)
                good = stay.get(pair)
                if good is None:
                    good = stay[pair] = v.apart(*pair)
            if good:
                return token
        raise ValueError("a symbol without a token")

    def _read_back(self, symbols: str, before: list[int]) -> tuple[int, ...]:
        v, n, out = self.vocabulary, len(symbols), []
        while n:
            token = before[n]
            out.append(token)
            n -= v.size[token]
        return tuple(out[::-1])

    def insert(self, symbols: str) -> tuple[int, ...]:
        """The tokens of a word. Nodes that earlier words made are only read."""
        keep = len(symbols) <= LONG_WORD
        node, before = 0, [-1]
        child, last = self.child, self.last
        for n, symbol in enumerate(symbols, 1):
            if keep:
                key = node << 13 | ord(symbol)
                node = child.get(key, 0)
                if not node:
                    last.append(self._last_token(symbols, n, before))
                    node = child[key] = len(last) - 1
                before.append(last[node])
            else:
                before.append(self._last_token(symbols, n, before))
        return self._read_back(symbols, before)

    def learn(self, words: set[str]) -> None:
        """Encode the words that are new; in order, so that the trie grows depth first."""
        chars, end = self.byte_chars, _END if self.vocabulary.suffix else 0
        if max(len(self.ids) / MAX_WORDS, len(self.last) / MAX_NODES, self.symbols / MAX_SYMBOLS) > 1:
            self.empty()
        if len(self.stay) > MAX_NODES:
            self.stay.clear()
        for word in sorted(words - self.ids.keys()):
            mapped = "".join([chars[b] for b in word.encode()])
            self.symbols += len(mapped)
            self.ids[word] = self.insert(mapped[:-1] + chr(ord(mapped[-1]) + end))

    # texts -------------------------------------------------------------------------------------------------------
    def cut(self, piece: str) -> list[str]:
        """The words of a piece of text without added tokens, normalised."""
        if _UNSURE.search(piece):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.vocabulary.source)
                self.byte_of = {c: b for b, c in enumerate(self.byte_chars)}
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
            return [bytes([self.byte_of[c] for c in word]).decode() for word, _ in found]
        piece = unicodedata.normalize("NFC", piece)
        # white space never lies within a word, so it need not be squeezed; a final sigma is not treated apart
        return self.vocabulary.cut_words.findall(piece.replace("Σ", "σ").lower())

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text; none for a null or empty one."""
        v, out, held, size = self.vocabulary, [], [], 0
        for k, text in enumerate(texts):
            pieces = v.split_added.split(text or "") if v.split_added else [text or ""]
            held.append([p if i % 2 else self.cut(p) for i, p in enumerate(pieces)])
            size += len(text or "")
            # a share of the texts at a time, so that the words of all of them never have to be held
            if size < BLOCK_CHARS and k + 1 < len(texts):
                continue
            self.learn({w for pieces in held for p in pieces[::2] for w in p})
            for pieces in held:
                ids: list[int] = []
                for p in pieces:
                    if isinstance(p, str):
                        ids.append(v.added[p])
                    else:
                        ids.extend(chain.from_iterable(map(self.ids.__getitem__, p)))
                out.append(ids)
            held, size = [], 0
        return out

    def decode(self, ids: list[int]) -> str:
        """The strings of the tokens joined by blanks, as for a file without a decoder."""
        text = self.vocabulary.text
        return " ".join([text[i] for i in ids])


def _arrow_lists(rows: list[list[int]]) -> pa.Array:
    flat = np.fromiter(chain.from_iterable(rows), np.int32, sum(map(len, rows)))
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32), flat)


def read_tokenizer(path: str) -> str:
    """The content of a tokenizer file, checked."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    Vocabulary(source)
    return source


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``ids`` (array of token ids) and ``decoded`` (the text these ids decode to).

    ``tokenizer`` is the path of a byte-level BPE file, read by the driver. A null or empty text has no ids and decodes
    to the empty string. Repeated rows and null ids are encoded like any other; an empty table gives no rows; other
    columns are not read. Texts and words of any length are encoded whole.
    """
    source = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def start():
        encoder = TrieEncoder(source.value)

        def run(texts: list) -> dict:
            ids = encoder.encode_all(texts)
            return {"ids": _arrow_lists(ids), "decoded": [encoder.decode(i) for i in ids]}

        return run

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, start, "ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Length and SHA-256 digests of what ``encode`` gave."""
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
