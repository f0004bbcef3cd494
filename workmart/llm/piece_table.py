"""SentencePiece encoding and decoding by a prefix table.

A merge-type (BPE) encoding has the property that every prefix of a text has one last token. The table holds that token
for each prefix: an automaton gives all vocabulary pieces that end at a place, and of those the one stays that may follow
the last token of the prefix before it. Two tokens may follow each other if merging their joined text gives just these
two again. The ids are then read from the end of the table backwards. The cost is linear in the length of the text.

Where two neighbouring characters stand together in no piece, no merge crosses. So a text falls into words before every
space mark, at every line end, and before punctuation that follows a letter in no piece; each word can be encoded alone,
and what recent words gave is kept in a bounded memory of the worker.

Results for odd inputs: a null text is an empty one, an empty text has no ids and decodes to the empty text; space marks
(U+2581) in a text are spaces, as in the library; characters without a piece become the pieces of their UTF-8 bytes.
Extra columns stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from workmart.llm.common import Recent, arrow_map, slices

SPACE = "▁"
#: Words that a worker remembers at least (at most twice as many), and the longest word that it remembers.
KEPT_WORDS, LONGEST_KEPT = 200_000, 48


class Strings:
    """Byte strings by number; `join` gives the strings of many numbers in one go."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.bytes = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def join(self, numbers: np.ndarray) -> bytes:
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        shift = np.repeat(self.starts[numbers] - (ends - lengths), lengths)
        return self.bytes[shift + np.arange(ends[-1])].tobytes()


class Follows(dict):
    """Which tokens may follow one token, or begin a text; tested when first asked."""

    def __init__(self, table: PieceTable, before: int | None):
        super().__init__()
        self.table, self.before = table, before

    def __missing__(self, i: int) -> bool:
        parts = [self.table.pieces[j] for j in (self.before, i) if j is not None]
        self[i] = found = self.table.merged("".join(parts)) == parts
        return found


class PieceTable:
    def __init__(self, model: bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=model)  # its vocabulary is read, nothing else
        size = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(size)]
        self.bytes_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if library.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes_of.items()}
        self.silent = {i for i in range(size) if library.is_control(i)}
        self.parts = np.array([library.is_control(i) for i in range(size)])
        self.unknown = library.unk_id()
        normal = [i for i in range(size) if i not in self.bytes_of and i not in self.silent and i != self.unknown and not library.is_unused(i)]
        self.ids = {self.pieces[i]: i for i in normal}
        self.scores = {self.pieces[i]: library.get_score(i) for i in normal}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the vocabulary has pieces over several words")
        self.characters = {p for p in self.ids if len(p) == 1}
        self.split = self._splitter().findall
        self.lengths = [len(p) for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.first, self.follows = Follows(self, None), {i: Follows(self, i) for i in normal}
        self.words = Recent(self._word, KEPT_WORDS, LONGEST_KEPT)
        shown = [bytes([self.bytes_of[i]]) if i in self.bytes_of else b"" if i in self.silent else " ⁇ ".encode() if i == self.unknown else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.shown, self.decimals = Strings(shown), Strings([b"%d," % i for i in range(size)])

    def _splitter(self) -> re.Pattern:
        marks = {c for c in self.characters if not c.isalnum() and c != SPACE}
        marks -= {b for p in self.ids for a, b in zip(p, p[1:]) if a.isalpha()}
        stop = re.escape("".join(sorted(marks)))
        return re.compile(f"\n|{SPACE}*[^\\W\\d_]++(?![^{SPACE}\n{stop}])|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the best pair first, of equal ones the leftmost."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _run(self, text: str) -> list[int]:
        """Ids of a text whose characters all have pieces."""
        size = len(text)
        table: list = [None] * size + [self.first]  # after each prefix, what may follow its last token; the empty prefix comes last, at -1
        ids, follows = [0] * size, self.follows
        for end, (length, i) in self.automaton.iter(text):
            if table[end] is None and table[end - length][i]:
                ids[end], table[end] = i, follows[i]
        found, at, lengths = [], size - 1, self.lengths
        while at >= 0:
            i = ids[at]
            found.append(i)
            at -= lengths[i]
        found.reverse()
        return found

    def _word(self, word: str) -> bytes:
        if self.characters.issuperset(word):
            return array("i", self._run(word)).tobytes()
        ids, run = [], ""
        for c in word:
            if c in self.characters:
                run += c
            else:
                ids += self._run(run) if run else []
                ids += [self.byte_ids[b] for b in c.encode()]
                run = ""
        return array("i", ids + (self._run(run) if run else [])).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.int32)
        words = self.split(SPACE + text.replace(" ", SPACE))
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """As the library: without the space that encoding puts first; bytes that are no UTF-8 become U+FFFD each."""
        try:  # a control piece parts the bytes around it
            text = "".join(self._loose(ids)) if self.parts[ids].any() else self.shown.join(ids).decode()
        except UnicodeDecodeError:
            text = "".join(self._loose(ids))
        first = next((i for i in ids.tolist() if i not in self.silent), None) if text.startswith(" ") else None
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text

    def _loose(self, ids: np.ndarray) -> Iterator[str]:
        run = b""
        for i in [*ids.tolist(), -1]:
            if i in self.bytes_of:
                run += bytes([self.bytes_of[i]])
                continue
            while run:
                size = next((n for n in (1, 2, 3, 4) if _is_character(run[:n])), 0)
                yield run[:size].decode() if size else "�"
                run = run[max(size, 1) :]
            if i >= 0:
                yield self.shown.join(np.array([i])).decode()

    def decimal(self, ids: np.ndarray) -> bytes:
        return self.decimals.join(ids)[:-1]


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_TABLES: dict[str, PieceTable] = {}


def table_of(model: bytes) -> PieceTable:
    """One table for each model in a Python worker; later tasks of the worker find it again."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _TABLES:
        _TABLES[key] = PieceTable(model)
    return _TABLES[key]


#: Result columns: name -> (type, maker of a value from the table, the ids and the decoded text).
OUTPUTS = {
    "ids": ("array<int>", pa.list_(pa.int32()), lambda t, ids, text: ids),
    "decoded": ("string", pa.string(), lambda t, ids, text: text),
    "n_tokens": ("long", pa.int64(), lambda t, ids, text: len(ids)),
    "ids_sha256": ("string", pa.string(), lambda t, ids, text: hashlib.sha256(t.decimal(ids)).hexdigest()),
    "decoded_sha256": ("string", pa.string(), lambda t, ids, text: hashlib.sha256(text.encode()).hexdigest()),
}


def encode(df: DataFrame, model_path: str, keep: list[str], text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """The columns `keep` and the wanted `outputs` of each row's text. The model's file is read by the driver (half a MB)."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches):
        table = table_of(model)
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1)
            made: list[list] = [[] for _ in outputs]
            for value in texts:
                ids = table.encode(value.as_py())
                decoded = table.decode(ids)
                for out, name in zip(made, outputs):
                    out.append(OUTPUTS[name][2](table, ids, decoded))
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(v, OUTPUTS[n][1]) for v, n in zip(made, outputs)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *outputs])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{n}` {OUTPUTS[n][0]}" for n in outputs])
    return arrow_map(df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")), run, schema)
