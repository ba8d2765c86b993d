"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts become one flat numpy array of code points, cut wherever two neighbours
stand next to each other inside no piece of the vocabulary: no merge can cross
such a place, so the stretches between ("words") are encoded on their own, each
distinct word of a chunk once.  All words advance together: a round looks up
the rank of every pair of neighbouring symbols, takes the smallest of each word
(a segmented minimum), merges all its places from the left at once, and drops
the words that have no pair left.

The library merges one pair at a time, best score first, then leftmost.  A
round does the same as a row of such steps unless a merge makes a neighbour
pair that scores as well or better; a word's round then ends with that merge.
Pieces that share one score (runs of spaces here) tie with what they make, so
their words are settled by one pass with a stack, leftmost first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NO_PAIR = np.iinfo(np.int32).max
# Code points encoded at once; longer texts are cut at word ends.
CHUNK = 1 << 20
# Distinct words a task remembers between chunks.
REMEMBERED = 1 << 16
# Rows of a batch handled, and returned, at once.
SLICE = 256


class Vocabulary:
    """Pieces, merge ranks and byte tables of a SentencePiece BPE model.

    The model must leave texts as they are (identity normalisation, a leading
    space, spaces as U+2581), fall back to bytes and have no user-defined or
    unused pieces; anything else raises ValueError.
    """

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        control = [i for i in range(n) if sp.is_control(i)]
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        probe = " ﬁ Á  \t　x "
        shown = "".join(sp.id_to_piece(i) for i in sp.encode(probe) if not sp.is_byte(i))
        if (sum(sp.is_byte(i) for i in range(n)) != 256 or any(sp.is_unused(i) for i in range(n))
                or shown != SPACE + "".join(c for c in probe.replace(" ", SPACE) if c != "\t" and sp.piece_to_id(c) != sp.unk_id())
                or min(sp.bos_id(), sp.eos_id()) < 0):
            raise ValueError(f"{path}: only byte-fallback models with identity normalisation are encoded")
        piece = {i: sp.id_to_piece(i) for i in range(n) if i not in special}
        self.bos, self.eos, self.size = sp.bos_id(), sp.eos_id(), n
        score = np.array([sp.get_score(i) for i in piece])
        place = dict(zip(piece, np.unique(-score, return_inverse=True)[1].tolist()))
        byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]

        # symbols: pieces by id, then characters that are no piece on their own
        symbol = {text: i for i, text in piece.items()}
        chars = sorted({c for text in piece.values() for c in text})
        for c in chars:
            symbol.setdefault(c, n + len(symbol))
        self.symbols = max(symbol.values(), default=0) + 1
        self.char_symbol = np.full(0x110000, -1, np.int32)
        self.char_index = np.zeros(0x110000, np.int32)
        for k, c in enumerate(chars, 1):
            self.char_symbol[ord(c)] = symbol[c]
            self.char_index[ord(c)] = k
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        pairs: dict[int, tuple[int, int]] = {}
        for i, text in piece.items():
            at = self.char_index[[ord(c) for c in text]]
            self.joined[at[:-1], at[1:]] = True
            for cut in range(1, len(text)):
                a, b = symbol.get(text[:cut]), symbol.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a * self.symbols + b] = (place[i], i)
        keys = sorted(pairs)
        self.keys = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self.ranks = np.array([*(pairs[k][0] for k in keys), NO_PAIR], np.int32)
        self.results = np.array([*(pairs[k][1] for k in keys), -1], np.int32)
        self.tied = np.zeros(len(place) + 1, bool)
        self.tied[:len(place)] = np.bincount(list(place.values()), minlength=len(place))[:len(place)] > 1
        self.pairs = pairs if self.tied.any() else {}

        # what a symbol decodes to, as UTF-8, and what it is written as (a piece, or its bytes)
        says = [b""] * self.symbols
        for text, s in symbol.items():
            says[s] = text.replace(SPACE, " ").encode()
        for b, i in enumerate(byte_id):
            says[i] = bytes([b])
        says[sp.unk_id()] = " ⁇ ".encode()
        self.text_at, self.text_bytes = _ragged([np.frombuffer(s, np.uint8) for s in says], np.uint8)
        self.byte_id = np.array(byte_id, np.int32)
        self.is_byte = np.zeros(self.symbols, bool)
        self.is_byte[byte_id] = True
        self.leads = np.zeros(self.symbols, bool)  # begins with U+2581
        self.leads[[s for text, s in symbol.items() if text[0] == SPACE]] = True
        self.silent = np.zeros(self.symbols, bool)
        self.silent[control] = True

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, result) of symbol pairs; NO_PAIR where nothing merges."""
        key = left.astype(np.int64) * self.symbols + right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NO_PAIR), np.where(hit, self.results[at], -1)

    def settle_ties(self, symbols: list[int], rank: int) -> list[int]:
        """Merge the pairs of ``rank``, leftmost first, until none is left or a better one appears."""
        none, pairs, width = (NO_PAIR, -1), self.pairs, self.symbols
        done: list[int] = []
        for at, s in enumerate(symbols):
            done.append(s)
            while len(done) > 1:
                got, result = pairs.get(done[-2] * width + done[-1], none)
                if got != rank:
                    break
                done[-2:] = [result]
                after = symbols[at + 1:at + 2]
                around = [pairs.get(done[-2] * width + result, none)[0]] if len(done) > 1 else []
                around += [pairs.get(result * width + after[0], none)[0]] if after else []
                if min(around, default=NO_PAIR) < rank:
                    return done + symbols[at + 1:]
        return done


def _ragged(rows: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, flat values) of rows of different lengths."""
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=at[1:])
    return at, np.concatenate(rows).astype(dtype) if rows else np.zeros(0, dtype)


def _gather(at: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length of each row, values of all) for chosen rows of a ragged table."""
    n = at[rows + 1] - at[rows]
    start = np.repeat(at[rows] - (np.cumsum(n) - n), n)
    return n, flat[start + np.arange(len(start))]


def _firsts(group: np.ndarray) -> np.ndarray:
    """True where a sorted array takes a new value."""
    out = np.ones(len(group), bool)
    out[1:] = group[1:] != group[:-1]
    return out


def merge(vocab: Vocabulary, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, word) after all merges; ``word`` numbers the words in ascending order."""
    done: list[tuple[np.ndarray, np.ndarray]] = []

    def ranked(sym, grp):
        rank, result = np.full(len(sym), NO_PAIR, np.int32), np.full(len(sym), -1, np.int32)
        at = np.flatnonzero(grp[1:] == grp[:-1])
        rank[at], result[at] = vocab.pair(sym[at], sym[at + 1])
        return rank, result

    rank, result = ranked(symbols, word)
    while len(symbols):
        first = _firsts(word)
        slot = np.cumsum(first) - 1
        best = np.minimum.reduceat(rank, np.flatnonzero(first))
        over = (best == NO_PAIR)[slot]
        if over.any():
            done.append((symbols[over], word[over]))
            symbols, word, rank, result = symbols[~over], word[~over], rank[~over], result[~over]
            continue
        tied = vocab.tied[best]
        if tied.any():
            pick = tied[slot]
            fresh_s, fresh_w = [], []
            bounds = np.append(np.flatnonzero(first), len(word))
            for w in np.flatnonzero(tied):
                part = vocab.settle_ties(symbols[bounds[w]:bounds[w + 1]].tolist(), int(best[w]))
                fresh_s.append(np.array(part, np.int32))
                fresh_w.append(np.full(len(part), word[bounds[w]], word.dtype))
            fs, fw = np.concatenate(fresh_s), np.concatenate(fresh_w)
            fr, fx = ranked(fs, fw)
            symbols, word = np.concatenate([symbols[~pick], fs]), np.concatenate([word[~pick], fw])
            rank, result = np.concatenate([rank[~pick], fr]), np.concatenate([result[~pick], fx])
            continue
        hit = rank == best[slot]
        # leftmost first: every second place of a run of neighbouring places
        places = np.flatnonzero(hit)
        run = np.ones(len(places), bool)
        run[1:] = places[1:] != places[:-1] + 1
        turn = np.arange(len(places)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        places = places[turn % 2 == 0]
        made, group = result[places], word[places]
        # pairs that a merge makes with its neighbours as they are at that moment
        left = symbols[np.maximum(places - 1, 0)]
        left = np.where(np.append(False, places[1:] == places[:-1] + 2), np.append(made[:1], made[:-1]), left)
        has_left = (places > 0) & (word[np.maximum(places - 1, 0)] == group)
        after = np.minimum(places + 2, len(word) - 1)
        has_right = (places + 2 < len(word)) & (word[after] == group)
        near = np.minimum(np.where(has_left, vocab.pair(left, made)[0], NO_PAIR),
                          np.where(has_right, vocab.pair(made, symbols[after])[0], NO_PAIR))
        turns = near <= rank[places]
        if turns.any():
            # the word's round ends with its first such merge
            count = np.cumsum(turns) - turns
            start = np.flatnonzero(_firsts(group))
            base = np.repeat(count[start], np.diff(np.append(start, len(group))))
            places = places[count == base]
        symbols = symbols.copy()
        symbols[places] = result[places]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        moved = places - np.arange(len(places))
        symbols, word, rank, result = symbols[keep], word[keep], rank[keep], result[keep]
        again = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
        within = again[again + 1 < len(word)]
        within = within[word[within] == word[within + 1]]
        rank[again], result[again] = NO_PAIR, -1
        rank[within], result[within] = vocab.pair(symbols[within], symbols[within + 1])
    if not done:
        return symbols, word
    symbols, word = np.concatenate([s for s, _ in done]), np.concatenate([w for _, w in done])
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


class Encoder:
    """Ids of texts; remembers the words it has met, up to a bound."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _points(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return np.where(points == 0x20, ord(SPACE), points)

    def _ends(self, points: np.ndarray) -> np.ndarray:
        """True where the next code point starts another word."""
        index = self.vocab.char_index[points]
        return ~self.vocab.joined[index[:-1], index[1:]]

    def _learn(self, words: list[str]) -> None:
        vocab = self.vocab
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbols, word = merge(vocab, vocab.char_symbol[self._points("".join(words))], word)
        # a character without a piece is a word of its own, or a symbol beyond the ids: its bytes
        lone = np.flatnonzero((symbols < 0) | (symbols >= vocab.size))
        n = np.ones(len(symbols), np.int64)
        said = [words[word[k]].encode() if symbols[k] < 0
                else vocab.text_bytes[vocab.text_at[symbols[k]]:vocab.text_at[symbols[k] + 1]].tobytes() for k in lone]
        n[lone] = [len(raw) for raw in said]
        ids = np.repeat(symbols, n).astype(np.int32)
        if said:
            ids[np.repeat(np.isin(np.arange(len(n)), lone), n)] = vocab.byte_id[np.frombuffer(b"".join(said), np.uint8)]
        at = np.append(0, np.cumsum(np.bincount(word, weights=n, minlength=len(words)).astype(np.int64)))
        self.at = np.append(self.at, self.at[-1] + at[1:])
        self.ids = np.append(self.ids, ids)

    def _units(self, texts: list[str]) -> Iterator[tuple[int, str]]:
        """(text number, stretch): whole texts, long ones cut at word ends."""
        for k, text in enumerate(texts):
            if not text:
                continue
            text, start = " " + text, 0
            while len(text) - start > CHUNK:
                width, cut = CHUNK, 0
                while not cut and start + width < len(text):
                    ends = np.flatnonzero(self._ends(self._points(text[start:start + width])))
                    cut = int(ends[-1]) + 1 if len(ends) else 0
                    width *= 2
                if not cut:
                    break
                yield k, text[start:start + cut]
                start += cut
            yield k, text[start:]

    def _chunk(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids per part, all ids)."""
        joined = "".join(parts).replace(" ", SPACE)
        sizes = np.array([len(p) for p in parts])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cut = np.append(self._ends(points), True)
        cut[np.cumsum(sizes) - 1] = True
        ends = np.flatnonzero(cut) + 1
        if len(self.number) > REMEMBERED:
            self._forget()
        number, new, rows, start = self.number, [], [], 0
        for end in ends.tolist():
            w = joined[start:end]
            got = number.get(w)
            if got is None:
                got = number[w] = len(number)
                new.append(w)
            rows.append(got)
            start = end
        if new:
            self._learn(new)
        n, ids = _gather(self.at, self.ids, np.array(rows, np.int64))
        part = np.searchsorted(np.cumsum(sizes), ends - 1, side="right")
        return np.bincount(part, weights=n, minlength=len(parts)).astype(np.int64), ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text with begin and end ids; a null text is empty."""
        out: list[list[np.ndarray]] = [[np.array([self.vocab.bos], np.int32)] for _ in texts]
        batch: list[tuple[int, str]] = []
        size = 0

        def flush():
            if batch:
                n, ids = self._chunk([s for _, s in batch])
                for (k, _), part in zip(batch, np.split(ids, np.cumsum(n)[:-1])):
                    out[k].append(part)
                batch.clear()

        for k, stretch in self._units([t or "" for t in texts]):
            batch.append((k, stretch))
            size += len(stretch)
            if size >= CHUNK:
                flush()
                size = 0
        flush()
        end = np.array([self.vocab.eos], np.int32)
        return [np.concatenate([*parts, end]) for parts in out]


def _mended(raw: bytes) -> str:
    """UTF-8 with U+FFFD for every single byte that is part of no character."""
    out, at = [], 0
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + width].decode())
            except UnicodeDecodeError:
                continue
            at += width
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


def decode(vocab: Vocabulary, rows: list[np.ndarray]) -> list[str]:
    """The text of each row of ids: control ids say nothing, the leading space goes.

    Ids outside the vocabulary raise IndexError, as in the library.
    """
    at, flat = _ragged([np.asarray(r, np.int64) for r in rows], np.int64)
    if len(flat) and (flat.min() < 0 or flat.max() >= vocab.size):
        raise IndexError("piece id is out of range")
    row = np.repeat(np.arange(len(rows)), np.diff(at))
    quiet = vocab.silent[flat]
    # a control id parts the bytes around it: such rows are read stretch by stretch
    parted = np.flatnonzero(quiet[1:] & vocab.is_byte[flat[:-1]] & (row[1:] == row[:-1])) + 1
    parted = set(row[parted[at[row[parted] + 1] > parted + 1]].tolist())
    flat, row = flat[~quiet], row[~quiet]
    n, text = _gather(vocab.text_at, vocab.text_bytes, flat)
    bounds = np.append(0, np.cumsum(np.bincount(row, weights=n, minlength=len(rows)).astype(np.int64)))
    lead = np.zeros(len(rows), bool)
    opens = np.flatnonzero(_firsts(row)) if len(row) else np.zeros(0, np.int64)
    lead[row[opens]] = vocab.leads[flat[opens]]
    blob, out = text.tobytes(), []
    for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        raw = blob[lo + int(lead[k]):hi]
        if k in parted:
            ids = np.asarray(rows[k], np.int64)
            said = [_mended(_gather(vocab.text_at, vocab.text_bytes, part)[1].tobytes())
                    for part in np.split(ids, np.flatnonzero(vocab.silent[ids]))]
            out.append("".join(said)[int(lead[k]):])
            continue
        try:
            out.append(raw.decode())
        except UnicodeDecodeError:
            out.append(_mended(raw))
    return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The tables of a model file, built once per process."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def public_model(name: str = "piece_bpe_32k") -> str:
    import public_tokenizers
    return public_tokenizers.path(f"{name}.model")


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): one row per row of ``docs``; ids as little-endian unsigned 32-bit integers.

    ``path`` names the model file, the same on every machine.  Begin and end
    ids are included; a null or empty text has just these.  Whole texts are
    encoded, whatever their length; null and repeated ids keep their rows, and
    other columns are ignored.  An empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        for batch in _slices(batches):
            ids = encoder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) for r in ids], pa.int64()),
                 pa.array([r.astype("<u4").tobytes() for r in ids], pa.binary())], [id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode_texts`` with their ``text``; null ids give a null text."""
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in _slices(batches):
            cells = batch.column(names.index("ids")).to_pylist()
            texts = decode(vocab, [np.frombuffer(c or b"", "<u4") for c in cells])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([None if c is None else t for c, t in zip(cells, texts)], pa.string())], [*names, "text"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{shape}, text string")
