"""BPE encoding and decoding with prefix sharing.

A batch's distinct words are put into a trie of symbols, whose runs without a branch are kept as one. A walk in depth-first order gives every place the last token of the encoding
of its path: the one token that ends the path and stands next to the last token of the path before it without the two being
merged otherwise. A prefix that many words share is thus encoded once, and a word's ids are read back from its end, token by token.

The tokens that end a path are known from its longest end that begins a token; these ends are states, and a state's steps are
remembered. Whether two tokens stand side by side is read off the merges along the edges that face each other, taken back from the
last one: the two stay apart if no merge of the tokens that meet there came before the merge that took one of them in.

Words, symbols and merge ranks are those of a vocabulary file; normalising and cutting follow it too. Strings of special tokens
in a text are those tokens, as in the library.

Defined cases: null text is empty and has no ids; empty ids decode to the empty text; very long texts are encoded whole (batches
are cut by bytes of text, and what a worker remembers of words is bounded); repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left
from collections.abc import Collection, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wayline.llm.bytetext import slices
from wayline.llm.common import giving_back, small_batches
from wayline.llm.pieces import PLAIN, Remembered, byte_symbols, in_symbols, library, plain_pattern, sent

#: Words whose ids, pairs of tokens whose stand, and steps of states, a worker remembers from one batch to the next.
REMEMBERED = 200_000
#: Bytes of text whose words are in memory at once.
BATCH_BYTES = 1 << 20
#: Stands for the end of a word inside this module, in symbols and tokens; no byte has it as its symbol.
END = "\0"


class State:
    """The longest end of a path that begins a token: the tokens that end there, longest first, with their lengths in symbols, and the steps known so far."""

    __slots__ = ("ends", "steps", "text")

    def __init__(self, text: str, ends: tuple[tuple[int, int], ...]):
        self.text, self.ends = text, ends
        self.steps: dict[str, State] = {}


class Merges:
    """A vocabulary with its merges, and what is known about pairs of tokens."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        marked = lambda t: t[: len(t) - len(suffix)] + END if suffix and t.endswith(suffix) else t
        self.ids = {marked(t): i for t, i in vocabulary.items()}
        self.end = END if suffix else ""
        self.shift = max(vocabulary.values()).bit_length()
        size = 1 << self.shift
        self.made, self.first, self.second = [-1] * size, [0] * size, [0] * size
        self.rank: dict[int, int] = {}
        for k, (a, b) in enumerate(merges):
            x, y = vocabulary[a], vocabulary[b]
            new = vocabulary[a[: len(a) - len(suffix)] + b if suffix and a.endswith(suffix) else a + b]
            if self.made[new] >= 0 or self.made[x] >= k or self.made[y] >= k:
                raise ValueError("a token with two ways to make it, or made before its parts")
            self.rank[x << self.shift | y] = k
            self.made[new], self.first[new], self.second[new] = k, x, y
        self.sorted = sorted(self.ids)
        self.known: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.states: dict[str, State] = {}
        self.start = State("", ())

    def apart(self, left: int, right: int, before: int = 1 << 60) -> bool:
        """Whether no merge ranked under `before` joins symbols of two tokens side by side, each of which is what BPE makes of its symbols."""
        rank, made = self.rank, self.made
        while True:
            if rank.get(left << self.shift | right, before) < before:
                return False
            if made[left] > made[right]:
                before, left = made[left], self.second[left]
            elif made[right] >= 0:
                # of equal pairs the one further left is merged first, so the token on the left may take what the right one wants
                before, right = made[right] + 1, self.first[right]
            else:
                return True

    def stand(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are what BPE makes of their symbols."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        yes = self.known[left << self.shift | right] = self.apart(left, right)
        return yes

    def reached(self, token: int) -> bool:
        """Whether a token is what BPE makes of its own symbols."""
        yes = self.whole.get(token)
        if yes is None:
            a, b, k = self.first[token], self.second[token], self.made[token]
            yes = self.whole[token] = k < 0 or self.reached(a) and self.reached(b) and self.apart(a, b, k)
        return yes

    def begins(self, text: str) -> bool:
        at = bisect_left(self.sorted, text)
        return at < len(self.sorted) and self.sorted[at].startswith(text)

    def step(self, state: State, symbol: str) -> State:
        """The state after one more symbol."""
        text, over = state.text + symbol, 0
        while not self.begins(text[over:]):
            over += 1
        text = text[over:]
        new = self.states.get(text)
        if new is None:
            if len(self.states) >= REMEMBERED:
                self.states, self.start.steps = {}, {}
            tokens = [(self.ids.get(text[k:]), len(text) - k - text.endswith(END)) for k in range(len(text) - text.endswith(END))]
            new = self.states[text] = State(text, tuple((t, n) for t, n in tokens if t is not None and self.reached(t)))
        state.steps[symbol] = new
        return new


def shared(a: str, b: str) -> int:
    """How many symbols two strings have in common at their beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def trie_of(words: Iterable[str], end: str) -> Iterator[tuple[str, int]]:
    """The words' trie, depth first: each word in order with the depth at which it leaves the path of the one before.

    Runs without a branch are no nodes of their own, so a prefix that words share takes no more room than one word, whatever its length. Where a word's last symbol
    holds the mark of its end, it is no symbol of a longer word's path.
    """
    before = ""
    for word in sorted(words):
        yield word, min(shared(before, word), len(before) - 1, len(word) - 1) if end and before else shared(before, word)
        before = word


def encode_words(words: Collection[str], merges: Merges) -> dict[str, bytes]:
    """The ids of distinct words in byte symbols, by a depth-first walk over the trie of their symbols."""
    out: dict[str, bytes] = {}
    known, shift, end = merges.known, merges.shift, merges.end
    # by depth on the current path: the state, the last token and how many symbols that spans
    longest = max(map(len, words), default=0) + 1
    states, tokens, spans = [merges.start] * longest, [0] * longest, [0] * longest
    for word, depth in trie_of(words, end):
        last = len(word) - 1 if end else -1
        while depth < len(word):
            symbol = word[depth] + END if depth == last else word[depth]
            state = states[depth].steps.get(symbol)
            if state is None:
                state = merges.step(states[depth], symbol)
            depth += 1
            for token, span in state.ends:
                if span == depth:
                    break
                left = tokens[depth - span]
                yes = known.get(left << shift | token)
                if yes or yes is None and merges.stand(left, token):
                    break
            states[depth], tokens[depth], spans[depth] = state, token, span
        ids = array("I")
        while depth:
            ids.append(tokens[depth])
            depth -= spans[depth]
        out[word] = ids[::-1].tobytes()
    return out


class WordEncoder:
    """Texts to ids: cuts texts as the vocabulary file says and encodes the words that a batch brings anew."""

    def __init__(self, file_json: str):
        spec = json.loads(file_json)
        model = spec["model"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self.is_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.cut = plain_pattern(split["pattern"]["Regex"]).findall
        self.file_json = file_json
        self.byte = {s: b for b, s in enumerate(byte_symbols())}
        self.ids: Remembered[str, bytes] = Remembered(REMEMBERED)

    @cached_property
    def library(self):
        """Needed for texts beyond plain Latin only; it takes some tens of MB."""
        return library(self.file_json)

    def words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.cut(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(self.byte[s] for s in piece).decode() for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def parts(self, text: str) -> list[tuple[bool, list[str]]]:
        """A text as runs of words, and special tokens between them."""
        if self.is_special is None or "<" not in text or not self.is_special.search(text):
            return [(False, self.words(text))]
        return [(True, [x]) if x in self.special else (False, self.words(x)) for x in self.is_special.split(text) if x]

    def made(self, words: set[str]) -> dict[str, bytes]:
        shown = {in_symbols(w): w for w in words}
        return {shown[s]: ids for s, ids in encode_words(shown, self.merges).items()}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        cut = [self.parts(t or "") for t in texts]
        ids = self.ids.of({w for runs in cut for special, words in runs if not special for w in words}, self.made).__getitem__
        return [b"".join(self.special[w[0]] if special else b"".join(map(ids, w)) for special, w in runs) for runs in cut]


def encode(docs: DataFrame, file: str) -> DataFrame:
    """(doc_id, ids) of every document; ids are little-endian unsigned 32-bit integers in a binary column."""
    small_batches(docs.sparkSession)
    vocabulary = sent(docs.sparkSession, file)

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary.value)
        for batch in slices(batches, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encoder.encode(batch.column("text").to_pylist()), pa.binary())], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(giving_back(encoded), "doc_id bigint, ids binary")


def token_names(file_json: str) -> dict[int, str]:
    spec = json.loads(file_json)
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


def text_of_ids(ids: bytes | None, names: dict[int, str]) -> str:
    """The tokens of the ids with a blank between two, as a vocabulary file without a decoder asks for."""
    return " ".join(map(names.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """Adds text, decoded from the ids."""
    vocabulary = sent(encoded.sparkSession, file)

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = token_names(vocabulary.value)
        for batch in batches:
            texts = [text_of_ids(x, names) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id bigint, ids binary, text string")


def round_trip(docs: DataFrame, file: str) -> DataFrame:
    """(doc_id, ids, text) of every document: decode of encode, by one Python worker a task instead of one for each of the two."""
    small_batches(docs.sparkSession)
    vocabulary = sent(docs.sparkSession, file)

    def both(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names = WordEncoder(vocabulary.value), token_names(vocabulary.value)
        for batch in slices(batches, BATCH_BYTES):
            ids = encoder.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([text_of_ids(x, names) for x in ids], pa.string())], names=["doc_id", "ids", "text"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(giving_back(both), "doc_id bigint, ids binary, text string")
