"""BPE encoding and decoding of whole texts as a streaming transducer with bounded lookahead."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import name, text_or_empty, unfold, whole_rows

VOCABULARY = "word_bpe_49k.json"
#: Characters of a text that are read at once, pieces that each half of the memo holds, and the longest piece that it takes.
BLOCK, MEMO, MEMO_PIECE = 1 << 16, 1 << 17, 48
#: Up to so many symbols are merged by looking through all pairs, more with a heap.
SHORT = 64

# Fixed values of the vocabulary file: white space and the pieces of its pre-tokenizer, and the mark of a word's end.
WHITE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if it is printable Latin-1, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """So many symbols before the end of what is known, tokens are settled whatever follows.

    What follows can only change tokens through a chain of merges of rising rank: each merge takes a left part that ends
    where the change has come to, and its right part begins there, that is, with the left part of the merge before (on the left edge
    of its tree) or with what followed. The change moves left by the length of the left part. The longest such chain, in
    symbols, is found in one pass over the merges: the best chain of a merge goes on from the best of any left edge of its right part.

    The list has to be proper, each part being made before the merge that uses it; a list that is not raises ValueError.
    """
    made: dict[str, tuple[int, str]] = {}
    best: dict[str, int] = {}
    most = 0
    for rank, (left, right) in enumerate(merges):
        if left + right in made:
            raise ValueError(f"two merges make {left + right!r}")
        reach, edge = 0, right
        while True:
            reach = max(reach, best.get(edge, 0))
            if edge not in made:
                if length(edge) > 1:
                    raise ValueError(f"{edge!r} is merged before it is made")
                break
            edge = made[edge][1]
        if left not in made and length(left) > 1:
            raise ValueError(f"{left!r} is merged before it is made")
        reach += length(left)
        best[left] = max(best.get(left, 0), reach)
        most = max(most, reach)
        made[left + right] = (rank, left)
    return most


class Vocabulary:
    """Merges, symbols and token strings of a BPE file with word ends, and the lookahead that its merges need."""

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path(VOCABULARY)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        ids = model["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        letters = byte_letters()
        single = {c + WORD_END for c in letters}
        self.lookahead = sufficient_lookahead(
            merges, lambda t: len(t) - len(WORD_END) if t in single or (len(t) > len(WORD_END) and t.endswith(WORD_END)) else len(t))
        self.inner = [ids[c] for c in letters]
        self.last = {ids[c]: ids[c + WORD_END] for c in letters}
        # both parts -> rank and made token, each pair of numbers in one
        self.pairs = {ids[a] << 32 | ids[b]: rank + 1 << 32 | ids[a + b] for rank, (a, b) in enumerate(merges)}
        self.none = len(merges) + 1 << 32
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        size = max(*ids.values(), *self.special.values()) + 1
        self.strings: list[str] = [""] * size
        for token, k in [*ids.items(), *self.special.items()]:
            self.strings[k] = token
        self.joined = [t.encode() for t in self.strings]
        of_letter = {c: bytes([b]) for b, c in enumerate(letters)}
        self.raw = [t.encode() if t in self.special else
                    b"".join(of_letter[c] for c in t.removesuffix(WORD_END)) + (b" " if t.endswith(WORD_END) else b"") for t in self.strings]

    def merged(self, symbols: list[int]) -> list[int]:
        """The tokens of a run of symbols: the pair of lowest rank first, the leftmost of equal ones."""
        return self._short(symbols) if len(symbols) <= SHORT else self._long(symbols)

    def _short(self, symbols: list[int]) -> list[int]:
        pairs, none = self.pairs, self.none
        token = list(symbols)
        found = [pairs.get(a << 32 | b, none) for a, b in zip(token, token[1:])]
        while found and (best := min(found)) != none:
            i = found.index(best)
            token[i] = made = best & 0xFFFFFFFF
            del token[i + 1], found[i]
            if i:
                found[i - 1] = pairs.get(token[i - 1] << 32 | made, none)
            if i < len(found):
                found[i] = pairs.get(made << 32 | token[i + 1], none)
        return token

    def _long(self, symbols: list[int]) -> list[int]:
        n, pairs = len(symbols), self.pairs
        token, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        # (rank and made token, place, both parts): a pair is passed over if its parts have changed meanwhile
        heap = [(p, i, token[i], token[i + 1]) for i in range(n - 1) if (p := pairs.get(token[i] << 32 | token[i + 1]))]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            made = best & 0xFFFFFFFF
            token[i], token[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if p := pairs.get(made << 32 | token[k]):
                    heapq.heappush(heap, (p, i, made, token[k]))
            if (h := before[i]) >= 0 and (p := pairs.get(token[h] << 32 | made)):
                heapq.heappush(heap, (p, h, token[h], made))
        return [t for t in token if t >= 0]


class Transducer:
    """The tokens of one piece whose symbols come in blocks: each is emitted once nothing that follows can change it.

    At most ``hold`` symbols and a block are kept, whatever the length of the piece.
    """

    def __init__(self, vocabulary: Vocabulary, hold: int | None = None):
        self.of, self.kept = vocabulary, []
        self.length = [len(t.encode()) if t in vocabulary.special else len(r) - (t.endswith(WORD_END) and len(t) > len(WORD_END))
                       for t, r in zip(vocabulary.strings, vocabulary.raw)]
        self.hold = hold or 4 * vocabulary.lookahead

    def push(self, symbols: list[int]) -> list[int]:
        """More symbols; returns the tokens that are settled by now."""
        out: list[int] = []
        for at in range(0, len(symbols), self.hold):
            self.kept += symbols[at:at + self.hold]
            if len(self.kept) > self.hold + self.of.lookahead:
                out += self._settled()
        return out

    def _settled(self) -> list[int]:
        # the last symbol is left out: it becomes another one if the piece ends with it
        known = len(self.kept) - 1
        out, end = [], 0
        for token in self.of.merged(self.kept[:-1]):
            if end + self.length[token] > known - self.of.lookahead:
                break
            out.append(token)
            end += self.length[token]
        self.kept = self.kept[end:]
        return out

    def end(self) -> list[int]:
        """The piece ends here; returns the rest of its tokens."""
        if not self.kept:
            return []
        symbols, self.kept = self.kept, []
        symbols[-1] = self.of.last[symbols[-1]]
        return self.of.merged(symbols)


def _composing() -> frozenset[str]:
    """The characters that can join the one before them when a text is composed."""
    seconds = {d[1] for i in range(0x110000) if (d := unicodedata.decomposition(chr(i)).split()) and d[0][0] != "<" and len(d) == 2}
    return frozenset({chr(int(x, 16)) for x in seconds} | {chr(i) for i in range(0x1161, 0x11C3)})


def recent(text: str) -> set[str]:
    """The characters of a text that this Python's Unicode tables lack; the library's may know them."""
    return set() if text.isascii() else {c for c in set(text) if unicodedata.category(c) == "Cn"}


_kinds: dict[int, str] = {}


def shadow(text: str) -> str:
    """The text with recent characters replaced by long known ones that the library takes for the same kind."""
    found = recent(text)
    for c in found:
        if ord(c) not in _kinds:
            from tokenizers import Regex, pre_tokenizers
            letter, number = (pre_tokenizers.Split(Regex(kind), "removed", invert=True).pre_tokenize_str(c) for kind in (r"\p{L}", r"\p{N}"))
            _kinds[ord(c)] = "\u0138" if letter else "\u0660" if number else "\xa7"
    return text.translate(_kinds) if found else text


class Encoder:
    """Token ids of texts, a block of characters at a time.

    ``ids(text)`` yields lists of ids. A text is cut at its special tokens, composed (NFC), lower-cased letter by
    letter and split into pieces; what may go on in the next block is carried over, and a piece that outgrows
    the carry is fed to a transducer while it lasts. Short pieces are remembered in a bounded memo.
    """

    def __init__(self, path: str | None = None, block: int = BLOCK, hold: int | None = None):
        import regex
        self.of = Vocabulary(path)
        self.block, self.hold, self.memo, self.older = block, hold, {}, {}
        self.pieces = regex.compile(PIECES)
        self.runs = [regex.compile(r"\p{L}*"), regex.compile(rf"[^{WHITE}\p{{L}}\p{{N}}]*")]
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.of.special, key=len, reverse=True))) if self.of.special else None
        self.widest = max(map(len, self.of.special), default=1)
        self.composing: frozenset[str] | None = None

    def symbols(self, piece: str) -> list[int]:
        inner = self.of.inner
        return [inner[b] for b in piece.encode("utf-8", "surrogatepass")]

    def piece(self, piece: str) -> list[int]:
        run = Transducer(self.of, self.hold) if len(piece) > MEMO_PIECE else None
        if run:
            return run.push(self.symbols(piece)) + run.end()
        made = self.older.get(piece)
        if made is None:
            symbols = self.symbols(piece)
            symbols[-1] = self.of.last[symbols[-1]]
            made = self.of.merged(symbols)
        if len(self.memo) >= MEMO:                  # pieces that are not met again go with the older half
            self.older = dict(self.memo)
            self.memo.clear()
        self.memo[piece] = made
        return made

    def composed(self, text: str, last: bool) -> tuple[str, str]:
        """The composed and lower-cased part of a text that is settled, and the raw rest."""
        cut = len(text)
        if not last and text:
            if self.composing is None:
                self.composing = _composing()
            cut -= 1                                # the last character may be joined by the next
            while cut > 0 and not text[cut].isascii() and (
                    unicodedata.combining(text[cut]) or text[cut] in self.composing or unicodedata.category(text[cut]) == "Cn"):
                cut -= 1
        known, rest = text[:cut], text[cut:]
        if known.isascii():
            return known.lower(), rest
        if recent(known):
            from tokenizers import normalizers as n
            return n.Sequence([n.NFC(), n.Lowercase()]).normalize_str(known), rest
        return unicodedata.normalize("NFC", known).replace("Σ", "σ").lower(), rest

    def ids(self, text: str) -> Iterator[list[int]]:
        raw, state = "", _Split(self)
        for at in range(0, len(text), self.block):
            raw += text[at:at + self.block]
            last = at + self.block >= len(text)
            begin = 0
            if self.special and "<" in raw:
                for m in self.special.finditer(raw):
                    made, _ = self.composed(raw[begin:m.start()], True)
                    yield state.feed(made, True) + [self.of.special[m[0]]]
                    begin = m.end()
            end = len(raw)
            if not last and self.special and (tail := raw.rfind("<", max(begin, end - self.widest + 1))) >= 0:
                end = tail                          # may be the start of a special token
                while (more := raw.rfind("<", max(begin, len(raw) - self.widest + 1), end)) >= 0:
                    end = more
            made, rest = self.composed(raw[begin:end], last)
            yield state.feed(made, last)
            raw = rest + raw[end:]


class _Split:
    """Pieces of composed text that comes in blocks."""

    def __init__(self, encoder: Encoder):
        self.of, self.carry, self.run, self.kind = encoder, "", None, 0

    def feed(self, text: str, last: bool) -> list[int]:
        """The settled ids of what has come so far; with ``last``, pieces end with this block."""
        of, out, begin = self.of, [], 0
        if self.run:
            begin = of.runs[self.kind].match(shadow(text)).end()
            out += self.run.push(of.symbols(text[:begin]))
            if begin == len(text) and not last:
                return out
            out += self.run.end()
            self.run = None
        text, self.carry = self.carry + text[begin:], ""
        shown = shadow(text)
        plain = shown is text
        if not last:
            # a piece that ends close to the block's end may go on, and an apostrophe may begin one of three letters
            for m in of.pieces.finditer(shown, self._safe(shown)):
                if m.end() > len(text) - 3:
                    text, self.carry = text[:m.start()], text[m.start():]
                    shown = shown[:m.start()]
                    break
        memo = of.memo
        for piece in of.pieces.findall(text) if plain else [text[m.start():m.end()] for m in of.pieces.finditer(shown)]:
            out += memo.get(piece) or of.piece(piece)
        if len(self.carry) > of.block:
            shown = shadow(self.carry)
            if of.pieces.match(shown).end() == len(shown):      # one run of letters or signs that outgrows a block
                self.kind, self.run = 0 if of.runs[0].match(shown).end() else 1, Transducer(of.of, of.hold)
                out += self.run.push(of.symbols(self.carry))
                self.carry = ""
        return out

    @staticmethod
    def _safe(text: str) -> int:
        """A place from which pieces can be split as from the start: behind the last space but for the final three characters."""
        return max(0, text.rfind(" ", 0, max(0, len(text) - 3)))


class Decoder:
    """Text of ids that come in blocks: a state machine over the tokens' bytes that holds back an unfinished character.

    As the vocabulary file names no decoder, ``joined`` puts a space between the token strings, as the library
    does. Otherwise letters become the bytes they stand for and a word's end becomes a space; bytes that are no
    UTF-8 become U+FFFD.
    """

    def __init__(self, vocabulary: Vocabulary, joined: bool = True):
        self.table, self.joined, self.begun = vocabulary.joined if joined else vocabulary.raw, joined, False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids) -> str:
        parts = [self.table[i] for i in ids]
        if self.joined:
            parts = [b" ".join(parts)]
            if ids and self.begun:
                parts.insert(0, b" ")
            self.begun = self.begun or len(ids) > 0
        return self.machine.decode(b"".join(parts))

    def end(self) -> str:
        return self.machine.decode(b"", True)


_made: dict[tuple, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def _little(ids: list[int]) -> bytes:
    import sys
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def token_ids(text: Column, path: str | None = None) -> Column:
    """The ids of each text (null: none), in Arrow batches."""
    @pandas_udf("array<int>")
    def of(texts):
        import pandas as pd
        made = encoder(path)
        return pd.Series([[i for part in made.ids(t or "") for i in part] for t in texts], dtype=object)
    return of(text)


def digests(text: Column, path: str | None = None) -> Column:
    """Number of ids, hash of the ids, and hash of the text decoded from them, without holding either whole."""
    @pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def of(texts):
        import pandas as pd
        made, rows = encoder(path), []
        for t in texts:
            n, of_ids, of_text, back = 0, hashlib.sha256(), hashlib.sha256(), Decoder(made.of)
            for part in made.ids(t or ""):
                n += len(part)
                of_ids.update(_little(part))
                of_text.update(back.push(part).encode("utf-8"))
            of_text.update(back.end().encode("utf-8"))
            rows.append((n, of_ids.hexdigest(), of_text.hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
    return of(text)


def encode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The frame with ``ids``, the token ids of each whole text, without a shuffle.

    A null or empty text has no ids. Rows are taken one by one, so repeated rows and ties have no part in it; a text of any
    length is read in blocks and takes constant memory beyond itself and its ids. An empty table gives an empty
    table, and an input column called ``ids`` gives way.
    """
    rows = df.select(whole_rows(df).alias("row"), token_ids(text_or_empty(text), path).alias("made"))
    return unfold(rows, "row", df.columns, [F.col("made")], ["ids"])


def decode(df: DataFrame, ids: str = "ids", joined: bool = False, path: str | None = None) -> DataFrame:
    """The frame with ``decoded``, the text of its column of ids (null: null), with spaces at word ends, or token
    strings joined by spaces if ``joined``.

    No ids give an empty text; bytes that are no UTF-8 become U+FFFD; an id that the vocabulary lacks, or a null one, is skipped.
    An empty table gives an empty table, and an input column called ``decoded`` gives way.
    """
    @pandas_udf("string")
    def of(rows):
        import pandas as pd
        made, out = encoder(path).of, []
        for r in rows:
            if r is None:
                out.append(None)
                continue
            back = Decoder(made, joined)
            known = [int(i) for i in r if i is not None and i == i and 0 <= i < len(made.strings)]
            out.append("".join([back.push(known[at:at + BLOCK]) for at in range(0, len(known), BLOCK)]) + back.end())
        return pd.Series(out, dtype=object)

    rows = df.select(whole_rows(df).alias("row"), of(name(ids).cast("array<int>")).alias("made"))
    return unfold(rows, "row", df.columns, [F.col("made")], ["decoded"])


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key n_tokens ids_sha256 decoded_sha256`` of every row: the ids as little-endian unsigned 32-bit numbers, and the text
    that the library's decoder makes of them, both hashed while they stream past. Odd rows are taken as in `encode`.
    """
    rows = df.select(name(key).alias("id"), digests(text_or_empty(text), path).alias("made"))
    return rows.select(F.col("id").alias(key), "made.n_tokens", "made.ids_sha256", "made.decoded_sha256")
