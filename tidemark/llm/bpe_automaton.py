"""BPE encoding and decoding with a tokenization automaton.

The automaton's states are tokens: the state is the token emitted last, and an
arc (state, token) exists when the two may stand side by side in a BPE encoding.
It starts with the base symbols, each free to follow each, and every merge
(a, b) -> c adds, in rank order, one gadget:

* nothing, where a has no arc to b just then: c can never come about;
* a new state c, whose outgoing arcs are those that state b has just then;
* an arc to c for every state that has an arc to a just then (but not from a
  itself when a = b, since merging runs from the left);
* and the arc from a to b goes.

A word has exactly one path from the start whose labels spell it: its encoding.
The gadgets are stored as the table (left part, right part, rank) of each
state, and an arc is worked out from them when it is first needed, so the
automaton has as many states as the vocabulary and no quadratic table.

Words are read by the automaton's byte form, which is deterministic: a table
(state, byte) -> state, compiled from the labels, with failure arcs; a state
lists the tokens that end there.  Any prefix of a word is spelled by one path
too, so at each byte exactly one of these tokens has an arc from the token that
the path had where it begins.  One step of the table for each byte finds it;
nothing is tried twice, and the labels are emitted from the last byte back.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from array import array
from itertools import islice

from pyspark.sql import DataFrame

from tidemark.llm.common import Recent, read_columns, reserved, table, tidy, worker_table

#: Words that a worker keeps; entries of its table of arcs before it is emptied; steps by failure arcs that it adds to the table at most.
WORDS, ARCS, STEPS = 240_000, 250_000, 50_000
#: Bytes, and _END.
_BYTES = 257
#: Stands for the tokenizer's end-of-word suffix inside a spelled word, whose other characters stand for single bytes.
_END = "\u0100"

#: The split pattern for lower-cased text; same pieces as with Unicode classes only for what _SPECIAL does not find.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_SPECIAL = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free character from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """Compiled from a tokenizer file; knows arcs, spells words as token ids and emits labels."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str = "</w>"):
        self.suffix = suffix
        self.label = {i: t for t, i in vocabulary.items()}
        self.rank: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.removed: dict[tuple[int, int], int] = {}
        self.never: set[int] = set()
        self.gadgets = len(merges)
        for k, pair in enumerate(merges):
            self._add_gadget(k, *pair if not isinstance(pair, str) else pair.split(" "), vocabulary)
        self.raw = {symbol: chr(b) for b, symbol in enumerate(byte_symbols())}
        self._compile(vocabulary)
        self.arcs: dict[int, bool] = {}

    def _compile(self, vocabulary: dict[str, int]) -> None:
        """The table of steps by byte.  States are numbered from the start, 0, as they come, and stored times _BYTES."""
        spelled = {i: self._spelled(text) for text, i in vocabulary.items() if i not in self.never}
        step: dict[int, int] = {}
        depth, own, came = [0], [-1], [(0, 0)]
        for i, text in sorted(spelled.items(), key=lambda x: len(x[1])):
            state = 0
            for ch in map(ord, text):
                if (to := step.get(state + ch)) is None:
                    step[state + ch] = to = len(depth) * _BYTES
                    depth.append(depth[state // _BYTES] + 1)
                    own.append(-1)
                    came.append((state, ch))
                state = to
            own[state // _BYTES] = i
        self.step, self.fail, self.compiled = step, array("q", [0]) * len(depth), len(step)
        self.sizes = array("i", [0]) * (1 + max(self.label))
        #: By state the tokens that end there, the longest first.
        self.ends: list[tuple[int, ...]] = [()] * len(depth)
        for k in sorted(range(1, len(depth)), key=depth.__getitem__):
            above, ch = came[k]
            fail = 0
            while above:
                above = self.fail[above // _BYTES]
                if (fail := step.get(above + ch, 0)) or not above:
                    break
            self.fail[k] = fail
            self.ends[k] = self.ends[fail // _BYTES]
            if own[k] >= 0:
                self.sizes[own[k]] = depth[k]
                self.ends[k] = (own[k], *self.ends[k])

    def _follow(self, state: int, ch: int) -> int:
        """A step that the table lacks, by failure arcs; it is added, and such steps are dropped when there are too many."""
        start = state
        while (to := self.step.get(state + ch)) is None and state:
            state = self.fail[state // _BYTES]
        to = to or 0
        if len(self.step) >= self.compiled + STEPS:
            for key in list(islice(reversed(self.step), STEPS)):
                del self.step[key]
        self.step[start + ch] = to
        return to

    @classmethod
    def of_model(cls, model: dict) -> MergeAutomaton:
        """``model`` as in a tokenizer file."""
        return cls(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")

    def _add_gadget(self, k: int, a: str, b: str, vocabulary: dict[str, int]) -> None:
        left, right, new = vocabulary[a], vocabulary[b], vocabulary[a + b]
        if left in self.never or right in self.never or not self._arc(left, right, k):
            self.never.add(new)
            return
        self.removed[left, right] = k
        self.rank[new], self.left[new], self.right[new] = k, left, right

    def _spelled(self, text: str) -> str:
        """The label's bytes as Latin-1 characters, and _END for the suffix."""
        s = self.suffix
        ends = s and text.endswith(s) and len(text) > len(s)
        return "".join(self.raw.get(ch, ch) for ch in (text[: -len(s)] if ends else text)) + (_END if ends else "")

    def arc(self, state: int, token: int) -> bool:
        """Whether the finished automaton has an arc from ``state`` by ``token``."""
        key = state << 32 | token
        if (known := self.arcs.get(key)) is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            self.arcs[key] = known = self._arc(state, token, self.gadgets)
        return known

    def _arc(self, state: int, token: int, before: int) -> bool:
        """The arc's history, from the last gadget back: ``before`` is the first gadget that no longer counts."""
        rank = self.rank
        while True:
            if self.removed.get((state, token), before) < before:
                return False
            made, came = rank.get(state, -1), rank.get(token, -1)
            if made < 0 and came < 0:
                return True
            if made > came:  # the state copied the arcs of its right part
                before, state = made, self.right[state]
            else:  # the token came to all states with an arc to its left part; rank + 1 leaves out a's own arc when a = b
                before, token = came + 1, self.left[token]

    def encode_word(self, word: str) -> list[int]:
        """The labels of the path that spells ``word``."""
        spelled = [*word.encode("utf-8", "surrogatepass")]
        if self.suffix:
            spelled.append(_BYTES - 1)
        step, ends, arcs, sizes, state, at = self.step, self.ends, self.arcs, self.sizes, 0, 0
        tokens = [-1]  # the last token of the path to each place
        put = tokens.append
        for ch in spelled:
            at += 1
            if (to := step.get(state + ch)) is None:
                to = self._follow(state, ch)
            state = to
            for t in ends[state // _BYTES]:
                n = sizes[t]
                if n == at or (known := arcs.get(tokens[at - n] << 32 | t)) or known is None and tokens[at - n] >= 0 and self.arc(tokens[at - n], t):
                    put(t)
                    break
            else:
                put(-1)
        path = []
        while at:
            if (t := tokens[at]) < 0:
                raise ValueError(f"no path spells {word!r}")
            path.append(t)
            at -= sizes[t]
        path.reverse()
        return path


class Encoder(Recent):
    """Word -> (ids as little-endian bytes, number of ids, labels joined by blanks); the table of a worker."""

    most = WORDS

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = MergeAutomaton.of_model(spec["model"])
        self.labels = self.automaton.label
        self.labels.update((i, t) for t, i in self.special.items())
        # the library's normaliser and splitter, for uncommon characters, without its model
        bare = {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}, "post_processor": None, "decoder": None, "truncation": None, "padding": None}
        self.library = Tokenizer.from_str(json.dumps(spec | bare))
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def make(self, word: str) -> tuple[bytes, int, str]:
        return self._entry(self.automaton.encode_word(word))

    def _entry(self, ids: list[int]) -> tuple[bytes, int, str]:
        packed = array("I", ids)
        return packed.tobytes(), len(ids), " ".join(map(self.labels.__getitem__, ids))

    def words(self, text: str) -> list[str]:
        if not _SPECIAL.search(text) and unicodedata.is_normalized("NFC", text):
            return _FAST.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in pieces]

    def encode(self, text: str | None) -> list[tuple[bytes, int, str]]:
        """An entry for each word and each special string of the text."""
        if not text:
            return []
        if "<|" not in text or not self.added.search(text):
            return list(map(self.__getitem__, self.words(text)))
        out = []
        for part in self.added.split(text):
            out += [self._entry([self.special[part]])] if part in self.special else map(self.__getitem__, self.words(part))
        return out


def encoder(path: str) -> Encoder:
    def make() -> Encoder:
        built = Encoder(path)
        gc.collect()
        tidy()
        gc.freeze()  # the automaton stays; the collector need not walk it again and again
        return built

    return worker_table(f"encoder {path}", make)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of every whole text; a map, nothing is shuffled.

    Null and empty texts have no ids.  Other columns pass through; ``ids`` must
    not be one of them.  Repeated rows are each encoded; an empty table gives no
    rows.
    """
    reserved(docs, ids)

    def read(texts: list[str | None]):
        table = encoder(path)
        return ([array("I", b"".join(e[0] for e in table.encode(x))).tolist() for x in texts],)

    return read_columns(docs, text, {ids: "array<int>"}, read)


def decode_documents(encoded: DataFrame, path: str, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the arc labels of its ids, joined by blanks; null ids give null."""
    reserved(encoded, name)

    def read(lists: list[list[int] | None]):
        label = encoder(path).labels.__getitem__
        return ([None if x is None else " ".join(map(label, x)) for x in lists],)

    return read_columns(encoded, ids, {name: "string"}, read)


def digest_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one map, so the ids of a text never leave its worker.

    Keys stay as they are, null ones too; null texts count as empty.
    """

    def read(texts: list[str | None]):
        table = encoder(path)
        n, ids, decoded = [], [], []
        for x in texts:
            entries = table.encode(x)
            n.append(sum(e[1] for e in entries))
            ids.append(hashlib.sha256(b"".join([e[0] for e in entries])).hexdigest())
            decoded.append(hashlib.sha256(" ".join([e[2] for e in entries]).encode()).hexdigest())
        return n, ids, decoded

    return read_columns(docs, text, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, read, [key])


def op9_bpe_automaton(spark, sf_dir):
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
