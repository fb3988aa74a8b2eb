"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a block of documents form a trie, kept as their sorted
order: a depth-first visit goes from word to word over the longest common
prefix, so each shared prefix is visited once. The state of a node is the last
token of the encoding of its prefix. That token is the one suffix of the prefix
that is a token and that may follow the state of the node where it starts;
walking these states backwards gives a word's encoding.

Two tokens may stand side by side if no merge joins them while they form: for
no pair of parts on the facing sides does a merge come before both parts are
used up inside their own tokens. The answers are kept by pair.

Defined results: null text is empty text; empty text has no tokens, an empty id
string and an empty decoded text. The strings of the special tokens in a text
are those tokens, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from codelathe.llm.common import opened, table, with_struct

#: Fixed values of the vocabulary file's pre-tokenizer.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+", regex.V1)
WORD_END = "</w>"
#: Distinct words whose encodings a task keeps: those of two generations, of which the older goes when the younger is full.
KEPT_WORDS = 160_000
#: Pairs of tokens whose side-by-side test a task keeps.
KEPT_PAIRS = 300_000

RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
FULL = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    for n, b in enumerate(x for x in range(256) if x not in set(plain)):
        out[b] = chr(256 + n)
    return out


def endings(tokens: dict[str, int]) -> dict[str, int]:
    out = {t[at:]: -1 for t in tokens for at in range(len(t))}
    out.update(tokens)
    return out


class TrieCodec:
    """Encoder and decoder of one vocabulary file (JSON of the tokenizers library, words ending in ``</w>``)."""

    def __init__(self, path: str):
        held = json.loads(open(path, encoding="utf-8").read())
        model = held["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END or held.get("decoder"):
            raise ValueError(f"{path} is not a word-end BPE vocabulary without a decoder")
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in held["added_tokens"] if x["special"] and not x["normalized"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.letter = {ord(chr(b)): letters[b] for b in range(256)}
        # A token as a string of letters; the word end is one more letter, so lengths count letters only.
        inner = {t: i for t, i in vocab.items() if not t.endswith(WORD_END) or t == WORD_END}
        final = {t[: -len(WORD_END)]: i for t, i in vocab.items() if t.endswith(WORD_END) and t != WORD_END}
        self.length = {i: len(t) for t, i in inner.items()} | {i: len(t) for t, i in final.items()}
        # Every ending of every token, with the token that it is or -1: a search for tokens at a place stops at the first string that ends none.
        self.inner_ends, self.final_ends = endings(inner), endings(final)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = n
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], n))
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.id_text = {i: str(i) for i in self.text_of}

    def _side(self, token: int, which: int) -> list[tuple[int, float]]:
        """Parts on the token's left (0) or right (1) side, each with the rank of the merge that uses it up."""
        held = self.right if which else self.left
        if token not in held:
            out, used, at = [], float("inf"), token
            while True:
                out.append((at, used))
                if at not in self.parts:
                    break
                used, at = self.parts[at][2], self.parts[at][which]
            held[token] = out
        return held[token]

    def may_follow(self, before: int, token: int) -> bool:
        """Whether encoding both tokens' letters together leaves just these two tokens."""
        found = self.beside.get((before, token))
        if found is None:
            rank = self.rank
            found = True
            for a, used_a in self._side(before, 1):
                for b, used_b in self._side(token, 0):
                    n = rank.get((a, b))
                    if n is not None and n < used_a and n <= used_b:  # of equal ranks the leftmost goes first
                        found = False
            if len(self.beside) > KEPT_PAIRS:
                self.beside.clear()
            self.beside[before, token] = found
        return found

    def _last(self, word: str, depth: int, states: list[int], ends: dict[str, int]) -> int:
        """The last token of the encoding of ``word[:depth]``."""
        found, beside = [], self.beside
        for at in range(depth - 1, -1, -1):
            token = ends.get(word[at:depth])
            if token is None:
                break
            if token >= 0:
                found.append((at, token))
        for at, token in reversed(found):
            if not at:
                return token
            good = beside.get((states[at], token))
            if good or good is None and self.may_follow(states[at], token):
                return token
        raise ValueError(f"no encoding of {word[:depth]!r}")

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Encodings of distinct non-empty words of byte letters."""
        out: dict[str, list[int]] = {}
        states, before = [-1], ""
        inner, final, length = self.inner_ends, self.final_ends, self.length
        for word in sorted(words):
            same, most = 0, min(len(before), len(word) - 1)
            while same < most and before[same] == word[same]:
                same += 1
            del states[same + 1 :]
            for depth in range(len(states), len(word)):
                states.append(self._last(word, depth, states, inner))
            token, at, ids = self._last(word, len(word), states, final), len(word), []
            while True:
                ids.append(token)
                at -= length[token]
                if not at:
                    break
                token = states[at]
            out[word] = ids[::-1]
            before = word
        return out

    def learn(self, words: set[str]) -> dict[str, tuple[str, str]]:
        """The id string and the decoded string of each word."""
        young, old, new = self.kept, self.older, []
        if len(young) > KEPT_WORDS // 2:
            young, old = {}, young
            self.kept, self.older = young, old
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    new.append(w)
        spelled = {w: w if w.isascii() and w.isprintable() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letter) for w in new}
        codes = self.encode_words(list(set(spelled.values())))
        id_text, text_of = self.id_text, self.text_of
        for w, s in spelled.items():
            ids = codes[s]
            young[w] = " ".join([id_text[i] for i in ids]), " ".join([text_of[i] for i in ids])
        return young

    def pieces(self, text: str) -> list[str]:
        """The text's words in order; special tokens stand as they are."""
        if self.split is None or not any(s in text for s in self.special):
            return WORDS.findall(normal(text))
        out: list[str] = []
        for part in self.split.split(text):
            out += [part] if part in self.special else WORDS.findall(normal(part))
        return out

    def encode_texts(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its ids joined by one space and its decoded text."""
        pieces = [self.pieces(t) for t in texts]
        words = {w for p in pieces for w in p}
        named = words & self.special.keys()
        kept = self.learn(words - named)
        for s in named:
            kept[s] = str(self.special[s]), s
        return [(" ".join([kept[w][0] for w in p]), " ".join([kept[w][1] for w in p])) for p in pieces]

    def decode(self, ids: list[int]) -> str:
        """The library's decode without a decoder: token strings joined by one space; unknown ids are left out."""
        return " ".join(self.text_of[i] for i in ids if i in self.text_of)


def normal(text: str) -> str:
    """NFC, then each character's own lower case (no rule for a final sigma)."""
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


@lru_cache(maxsize=2)
def codec(path: str) -> TrieCodec:
    return TrieCodec(path)


def forget() -> None:
    """Drop the codecs at a task's end: Python workers live on, and their memory counts."""
    codec.cache_clear()


def vocabulary(path: str | None = None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, text: str = "text", path: str | None = None) -> tuple[DataFrame, str]:
    """``df`` plus a struct of ids and decoded text of the column ``text``."""
    path = vocabulary(path)

    def make():
        held = codec(path)

        def step(array: pa.Array) -> pa.StructArray:
            found = held.encode_texts([x or "" for x in array.to_pylist()])
            return pa.StructArray.from_arrays([pa.array([[int(i) for i in a.split()] for a, _ in found], pa.list_(pa.int32())), pa.array([b for _, b in found], pa.string())], ["ids", "decoded"])

        step.close = forget
        return step

    return with_struct(df, text, FULL, make, "bpe", 1 << 20)


def digests(df: DataFrame, text: str = "text", path: str | None = None) -> tuple[DataFrame, str]:
    """``df`` plus a struct of token count and digests of ids and decoded text."""
    path = vocabulary(path)

    def make():
        held = codec(path)

        def step(array: pa.Array) -> pa.StructArray:
            found = held.encode_texts([x or "" for x in array.to_pylist()])
            sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
            return pa.StructArray.from_arrays([pa.array([a.count(" ") + 1 if a else 0 for a, _ in found], pa.int64()), pa.array([sha(a) for a, _ in found], pa.string()), pa.array([sha(b) for _, b in found], pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

        step.close = forget
        return step

    return with_struct(df, text, RESULT, make, "bpe")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, out = digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return opened(df, ["doc_id"], out)
