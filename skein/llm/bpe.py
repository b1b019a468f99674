"""BPE encoding by per-prefix dynamic programming, and decoding.

The greedy merge procedure gives every prefix of a word one encoding, so every
prefix has one last token. A suffix automaton over the vocabulary yields, while
a word is read once, all tokens that end at each position; the one that may
stand after the last token of the prefix before it - the pair would not be cut
or merged otherwise by any earlier merge - is that prefix's last token. Back
pointers from the whole word then give the exact ids. Words repeat, so every
worker remembers words it has encoded, in a table of bounded size; a forgotten
word is computed again.

Edge cases: null and empty texts have no ids and decode to the empty text;
special tokens written in a text are found before normalisation, as the
tokenizers library does; any text length works, as words are handled one by
one; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import arrow_schema, batches, bounded_batches, kept, texts

REMEMBERED = 400_000
#: Lengths of prefixes whose last tokens are remembered, as words share them.
PREFIXES = (8, 6, 4)
NO_PARENT = 1 << 60
#: Characters at which str.split cuts though they are no white space for the tokenizer.
SPLIT_ONLY = "\x1c\x1d\x1e\x1f"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class VocabularyAutomaton:
    """Suffix automaton of all tokens: reading a word, it stands at the longest suffix
    that occurs in the vocabulary, and links lead to the tokens that end there."""

    def __init__(self, tokens: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for token in tokens:
            last = 0
            for symbol in token:
                last = self._extend(last, symbol)
        ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for token, number in tokens.items():
            state = 0
            for symbol in token:
                state = self.next[state][symbol]
            ends[state].append((len(token), number))
        #: For each state the tokens that are suffixes of its strings, longest first.
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            own = sorted(ends[state], reverse=True)
            self.ends[state] = (*own, *self.ends[self.link[state]]) if state else ()

    def _clone(self, of: int, length: int) -> int:
        self.next.append(dict(self.next[of]))
        self.link.append(self.link[of])
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, symbol: str) -> int:
        known = self.next[last].get(symbol)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, symbol, known)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            known = self.next[at][symbol]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, symbol, known)
        return new

    def _split(self, at: int, symbol: str, known: int) -> int:
        copy = self._clone(known, self.length[at] + 1)
        self.link[known] = copy
        while at >= 0 and self.next[at].get(symbol) == known:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy


class Remembered(dict):
    """Values by key, made when they are first asked for."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        found = self[key] = self.make(key)
        return found


class WordBpe:
    """A tokenizer file with byte-level words that end in a suffix mark."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("decoder") is not None or not model.get("end_of_word_suffix"):
            raise ValueError("expected BPE with an end-of-word suffix and no decoder")
        self.suffix = model["end_of_word_suffix"]
        self.words = regex.compile(next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.text_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        ids = model["vocab"]
        #: Rank of the merge of two tokens, and the rank and halves that made each token.
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(merges)}
        self.made = {ids[a + b] if not a.endswith(self.suffix) else None: (r, ids[a], ids[b]) for r, (a, b) in enumerate(merges)}
        self.automaton = VocabularyAutomaton({self._symbols(t): i for t, i in ids.items()})
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.prefixes: dict[str, tuple[int, int, list[int], list[int]]] = {}
        self.known = Remembered(self._written)
        self.known_words: dict[str, list[int]] = {}

    def _symbols(self, token: str) -> str:
        """A letter with the suffix mark is one symbol, moved into a private range."""
        return token if not token.endswith(self.suffix) else token[: -len(self.suffix) - 1] + chr(0xE000 + ord(token[-len(self.suffix) - 1]))

    def _spine(self, token: int, half: int, held: dict) -> list[tuple[int, int]]:
        """The pieces that stand at one end of a token while it is built, each with the rank that ends it."""
        if (found := held.get(token)) is None:
            found, until = [], NO_PARENT
            piece = token
            while True:
                found.append((piece, until))
                if piece not in self.made:
                    break
                until, piece = self.made[piece][0], self.made[piece][half]
            held[token] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging can leave a before b: no merge across their border comes first.

        A piece at the border lives until the merge that absorbs it. A merge of the
        two border pieces takes place if its rank comes before both ends; of equal
        ranks the left place is merged first, which is the border for the right piece.
        """
        rank, lefts, found = self.rank.get, self._spine(b, 1, self.left), a >= 0
        for x, x_until in self._spine(a, 2, self.right) if found else ():
            for y, y_until in lefts:
                r = rank((x, y))
                if r is not None and r < x_until and r <= y_until:
                    found = False
                    break
            if not found:
                break
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[a << 32 | b] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one normalised word."""
        shown = "".join([self.letters[b] for b in word.encode()])
        to, link, length, ends = self.automaton.next, self.automaton.link, self.automaton.length, self.automaton.ends
        pairs, compatible = self.pairs, self.compatible
        last: list[int] = []
        back: list[int] = []
        state = matched = end = 0
        size = len(shown)
        for n in PREFIXES:
            if n < size and (held := self.prefixes.get(shown[:n])) is not None:
                state, matched, last, back = held
                last, back, end = last.copy(), back.copy(), n
                break
        begun = end
        for symbol in shown[end:-1] + chr(0xE000 + ord(shown[-1])):
            if end in PREFIXES and end > begun:
                self._keep(shown[:end], state, matched, last, back)
            end += 1
            while state and symbol not in to[state]:
                state = link[state]
                matched = length[state]
            state = to[state].get(symbol, -1)
            if state < 0:  # a byte that the vocabulary lacks
                state = matched = 0
                last.append(-1)
                back.append(end - 1)
                continue
            matched += 1
            for size, token in ends[state]:
                if size > matched:
                    continue
                start = end - size
                if start:
                    before = last[start - 1]
                    fits = pairs.get(before << 32 | token)
                    if not (compatible(before, token) if fits is None else fits):
                        continue
                last.append(token)
                back.append(start)
                break
        ids = []
        while end:
            ids.append(last[end - 1])
            end = back[end - 1]
        return [i for i in reversed(ids) if i >= 0]

    def _keep(self, prefix: str, state: int, matched: int, last: list[int], back: list[int]) -> None:
        if len(self.prefixes) >= REMEMBERED // 4:
            self.prefixes.clear()
        self.prefixes[prefix] = state, matched, last.copy(), back.copy()

    def _word(self, word: str) -> list[int]:
        """encode_word, remembered."""
        found = self.known_words.get(word)
        if found is None:
            if len(self.known_words) >= REMEMBERED:
                self.known_words.clear()
            found = self.known_words[word] = self.encode_word(word)
        return found

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: letters are lowered one by one
        text = text.lower()
        if text.isalpha():
            return self._word(text)
        return [i for word in self.words.findall(text) for i in self._word(word)]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.special_cut.split(text) if self.special_cut else [text]:
            ids += [self.special[part]] if part in self.special else self.encode_plain(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as for a tokenizer file without a decoder."""
        return " ".join([self.text_of[i] for i in ids])

    def _written(self, chunk: str) -> tuple[str, str]:
        ids = self.encode_plain(chunk)
        return " ".join(map(str, ids)), self.decode(ids)

    def written(self, text: str) -> tuple[str, str]:
        """Decimal ids and decoded tokens, both joined by spaces.

        No token spans white space, so a text is the sequence of its chunks between
        white space, and each chunk is encoded once as long as it is remembered.
        """
        if self.special_cut and self.special_cut.search(text) or any(c in text for c in SPLIT_ONLY):
            ids = self.encode(text)
            return " ".join(map(str, ids)), self.decode(ids)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        both = list(map(self.known.__getitem__, text.split()))
        if not both:
            return "", ""
        a, b = zip(*both, strict=True)
        return " ".join(a), " ".join(b)


def load(spec_text: str) -> WordBpe:
    return kept("bpe-" + hashlib.sha256(spec_text.encode()).hexdigest(), lambda: WordBpe(json.loads(spec_text)))


def word_bpe() -> str:
    """The JSON of the public word-level tokenizer file."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


#: What encode_table can give of a text's decimal ids and of its decoded text.
OUTPUTS = {
    "ids": lambda ids, decoded: ids,
    "decoded": lambda ids, decoded: decoded,
    "ids_sha256": lambda ids, decoded: hashlib.sha256(ids.encode()).hexdigest(),
    "decoded_sha256": lambda ids, decoded: hashlib.sha256(decoded.encode()).hexdigest(),
}


def encode_table(docs: DataFrame, spec_text: str, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """(key, n_tokens, *outputs) of every row.

    spec_text is the tokenizer file's JSON, a fixed vocabulary that doesn't grow with the data.
    """
    bounded_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(spec_text)
    ddl = "row_key long, n_tokens long, " + ", ".join(f"{x} string" for x in outputs)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, bpe = arrow_schema(ddl), load(spec.value)
        for batch in it:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = {n: [] for n in schema.names}
                for key, x in zip(part.column("row_key").to_pylist(), texts(part, "row_text"), strict=True):
                    ids, decoded = bpe.written(x)
                    rows["row_key"].append(key)
                    rows["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                    for name in outputs:
                        rows[name].append(OUTPUTS[name](ids, decoded))
                yield batches(rows, schema)

    return docs.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("row_text")).mapInArrow(run, ddl).withColumnRenamed("row_key", key)
