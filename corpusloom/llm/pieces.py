"""SentencePiece encoding and decoding by a max-plus scan over the chunks of a text.

A text is written as its best-scoring chain of pieces. Scores are integers, so sums are exact and
the result of a text cut into chunks is that of the whole text, ties included: of equal chains the
one with the longer last piece wins, from the end backwards.
"""

import re
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import write_scratch

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = "▁", "\udc81"  # how a space is written; how that sign itself is, in a text
UNIT = 1 << 16
NEVER = -(1 << 60)
# Of the words met last, and of the parts of long ones, up to twice as many are kept: about 250 bytes each.
CACHED_WORDS, CACHED_PARTS = 150_000, 75_000
LONG_WORD = 64  # characters of the words that are cut into parts
TOGETHER = 1 << 20  # characters of the texts whose words are encoded together
CHUNK = 1 << 16


@dataclass
class PieceTable:
    """Pieces with integer scores. ``trie`` leads from character to character; where a piece ends,
    its id stands under the empty string."""

    pieces: dict[str, int]
    trie: dict
    scores: list[int]
    written: list[bytes]  # what each id stands for
    byte_ids: list[int]
    unknown: int
    longest: int
    pairs: frozenset[str]  # neighbouring characters of pieces; between others no piece lies
    seen: dict[str, bytes] = field(default_factory=dict)
    known: dict[str, tuple[bytes, int]] = field(default_factory=dict)
    seen_before: dict[str, bytes] = field(default_factory=dict)
    known_before: dict[str, tuple[bytes, int]] = field(default_factory=dict)
    tails: dict[str, list] = field(default_factory=dict)

    def forward(self, text: str, entries: list[tuple[int, int]], limit: int):
        """Best scores of the positions of ``text`` reached by pieces that begin before ``limit``,
        and where the last piece begins: -2 at an entry, -1 if not reached."""
        n, longest, scores, unknown = len(text), self.longest, self.scores, self.unknown
        best, back = [NEVER] * (limit + longest), [-1] * (limit + longest)
        for position, score in entries:
            best[position], back[position] = score, -2
        for i in range(limit):
            here = best[i]
            if here == NEVER:
                continue
            node = self.trie.get(text[i])
            j = i + 1
            if node is None or "" not in node:
                # No piece is this character alone: it is written as bytes.
                if here + unknown > best[j]:
                    best[j], back[j] = here + unknown, i
            while node is not None:
                piece = node.get("")
                if piece is not None:
                    score = here + scores[piece]
                    if score > best[j]:
                        best[j], back[j] = score, i
                if j == n:
                    break
                node = node.get(text[j])
                j += 1
        return best, back

    def ids(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        if known is not None:
            return [known]
        plain = SPACE if piece == LITERAL else piece
        return [self.byte_ids[b] for b in plain.encode("utf-8", "surrogatepass")]

    def chain(self, text: str, back: list[int], end: int) -> tuple[list[list[int]], list[int]]:
        """The pieces of the best chain that ends at ``end`` and the positions it visits."""
        pieces, visited = [], [end]
        while back[end] >= 0:
            pieces.append(self.ids(text[back[end] : end]))
            end = back[end]
            visited.append(end)
        return pieces[::-1], visited[::-1]

    def part(self, text: str) -> tuple[bytes, int]:
        """The ids and the score of a text that no piece reaches out of; kept for the next time."""
        found = self.known.get(text)
        if found is None:
            if len(self.known) >= CACHED_PARTS:
                # Parts that recur come back from the older dict; the others go with it.
                self.known, self.known_before = {}, self.known
            found = self.known_before.get(text)
            if found is None:
                best, back = self.forward(text, [(0, 0)], len(text))
                pieces, _ = self.chain(text, back, len(text))
                found = np.array([i for ids in pieces for i in ids], "<i4").tobytes(), best[len(text)]
            self.known[text] = found
        return found

    def parts(self, text: str) -> list[tuple[bytes, int]]:
        """``part`` of the parts of a text, which is cut where no piece can lie."""
        pairs, begin, out = self.pairs, 0, []
        for end in range(1, len(text) + 1):
            if end == len(text) or text[end - 1 : end + 1] not in pairs:
                out.append(self.part(text[begin:end]))
                begin = end
        return out

    def encode_part(self, text: str) -> bytes:
        """The ids of a long word, which ``encode`` keeps; one of a single part is not kept a second time."""
        parts = self.parts(text)
        if len(parts) == 1:
            self.known.pop(text, None)
        return b"".join([ids for ids, _ in parts])

    def backwards(self) -> dict[str, list]:
        """The pieces from their last character on: ``[what stands before it, score, id]`` by character."""
        if not self.tails:
            for name, i in self.pieces.items():
                level = self.tails
                for c in reversed(name):
                    node = level.setdefault(c, [{}, None, None])
                    level = node[0]
                node[1:] = self.scores[i], np.array([i], "<i4").tobytes()
        return self.tails

    def encode_words(self, words) -> dict[str, bytes]:
        """The ids of different short words, each with a space before it.

        The best chain to a position depends on nothing behind it, so in sorted order a word goes on
        from the characters that it has in common with the one before.
        """
        tails, unknown, out = self.backwards(), self.unknown, {}
        best, ids, last = [0], [b""], ""
        for word in sorted(words):
            text = SPACE + word
            shared, most = 0, min(len(last), len(text))
            while shared < most and last[shared] == text[shared]:
                shared += 1
            del best[shared + 1 :], ids[shared + 1 :]
            for end in range(shared, len(text)):
                begin, node = end, tails.get(text[end])
                if node is None or node[1] is None:
                    # No piece is this character alone: it is written as bytes.
                    top, at, own = best[end] + unknown, end, np.array(self.ids(text[end]), "<i4").tobytes()
                else:
                    top = NEVER
                while node is not None:
                    before, score, piece = node
                    if score is not None:
                        score += best[begin]
                        if score >= top:
                            top, at, own = score, begin, piece
                    if not begin:
                        break
                    begin -= 1
                    node = before.get(text[begin])
                best.append(top)
                ids.append(ids[at] + own)
            out[word] = ids[-1]
            last = text
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, see ``encode_all``."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; words that recur are encoded once, and kept without their first space."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(words_of(text))
            size += len(text or "")
            if size >= TOGETHER:
                out += self._encode_group(group)
                group, size = [], 0
        return out + self._encode_group(group)

    def _encode_group(self, group: list[list[str]]) -> list[np.ndarray]:
        needed = set().union(*group)
        new = needed - self.seen.keys()
        if len(self.seen) + len(new) > CACHED_WORDS:
            # Words that recur come back from the older dict; the others go with it.
            self.seen, self.seen_before, new = {}, self.seen, needed
        seen, before, short = self.seen, self.seen_before, []
        for word in new:
            ids = before.get(word)
            if ids is not None:
                seen[word] = ids
            elif len(word) > LONG_WORD:
                seen[word] = self.encode_part(SPACE + word)
            else:
                short.append(word)
        seen.update(self.encode_words(short))
        return [np.frombuffer(b"".join([seen[w] for w in words]), "<i4") for words in group]

    def decode(self, ids) -> str:
        known = self.written
        text = b"".join([known[i] for i in ids])
        return text[1:].decode("utf-8", "surrogatepass")


def written(text: str) -> str:
    """A text as pieces see it: begun by a space, spaces visible, the sign for them set apart."""
    return SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)


def words_of(text: str | None) -> list[str]:
    """A text cut before its spaces, each word without the first space before it."""
    if not text:
        return []
    words = text.split(" ")
    if "" in words or SPACE in text:
        # Runs of spaces may be pieces, so they stay with the word that follows.
        words = [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", written(text))]
    return words


_CACHES = ("seen", "known", "seen_before", "known_before", "tails")


def shared_table(spark, table: PieceTable):
    """A broadcast of plain dicts and lists, a few MB whatever the corpus: a broadcast is pickled by
    name, so an object would need this package on the executors."""
    plain = {f.name: getattr(table, f.name) for f in fields(table) if f.name not in _CACHES}
    return spark.sparkContext.broadcast(plain)


def _rebuilt(shared) -> PieceTable:
    """The table of a broadcast; a worker keeps it, and with it what it has encoded."""
    held = shared.value
    if "" not in held:
        held[""] = PieceTable(**held)
    return held[""]


def load_pieces(path: str = MODEL, by_rank: bool = True) -> PieceTable:
    """The pieces of a SentencePiece model with byte fallback.

    Pair-merging models give the order of merges instead of probabilities. With ``by_rank`` that
    order stands for frequency by Zipf's law: rank r has the log probability -ln(r + 1) less that
    of the sum. Without it the model's own scores are taken. A character without a piece is written
    as its bytes and costs 10 more than the worst piece. The model normalises nothing here, so
    decoding gives back every text.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    normal = [i for i in range(len(names)) if not special(i)]
    ranks = sorted(normal, key=lambda i: (-model.get_score(i), i))
    scores = [0] * len(names)
    mass = sum(1 / (r + 1) for r in range(len(ranks)))
    for r, i in enumerate(ranks):
        own = -np.log((r + 1) * mass) if by_rank else model.get_score(i)
        scores[i] = round(float(own) * UNIT)
    trie: dict = {}
    for i in normal:
        node = trie
        for c in names[i]:
            node = node.setdefault(c, {})
        node[""] = i
    if any(SPACE in name.lstrip(SPACE) for name in (names[i] for i in normal)):
        raise ValueError("pieces must not hold a space after another character")
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    shown = [names[i].replace(SPACE, " ").encode() if not special(i) else b"" for i in range(len(names))]
    for b, i in enumerate(byte_ids):
        shown[i] = bytes([b])
    least = min(scores[i] for i in normal)
    own = {names[i]: i for i in normal}
    longest = max(len(names[i]) for i in normal)
    pairs = frozenset(a + b for name in own for a, b in zip(name, name[1:]))
    return PieceTable(own, trie, scores, shown, byte_ids, least - 10 * UNIT, longest, pairs)


def _cuts(table: PieceTable, text: str) -> np.ndarray:
    """Positions that no piece crosses: between characters that are neighbours in none."""
    return np.array([i for i in range(1, len(text)) if text[i - 1 : i + 1] not in table.pairs], dtype=np.int64)


def transfer(table: PieceTable, text: str, limit: int) -> np.ndarray:
    """The boundary matrix of a chunk: the best score from ``i`` characters after its begin to ``j``
    after its end, over chains whose pieces begin within it. ``text`` reads on past ``limit``."""
    size = table.longest
    out = np.full((size, size), NEVER, dtype=np.int64)
    cuts = _cuts(table, text[: limit + 1])
    cuts = cuts[(cuts >= size - 1) & (cuts < limit)]
    # All chains meet at a cut: before the first one every begin is walked, after the last one the
    # common end, and between them parts add up.
    meet, rest = limit, None
    if len(cuts):
        meet, last = int(cuts[0]), int(cuts[-1])
        between = sum(score for _, score in table.parts(text[meet:last]))
        best, _ = table.forward(text[last:], [(0, 0)], limit - last)
        rest = np.array(best[limit - last : limit - last + size], dtype=np.int64)
        rest = np.where(rest > NEVER, rest + between, NEVER)
    for i in range(size):
        if i >= limit:
            # The chunk is the last one and shorter than the piece that reaches into it.
            if i - limit < size:
                out[i, i - limit] = 0
            continue
        best, _ = table.forward(text, [(i, 0)], meet)
        if rest is None:
            out[i] = best[limit : limit + size]
        elif best[meet] > NEVER:
            out[i] = np.where(rest > NEVER, rest + best[meet], NEVER)
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices, or of two stacks of them."""
    sums = a[..., :, :, None] + b[..., None, :, :]
    return np.maximum(sums.max(axis=-2), NEVER)


def _states(frame: pd.DataFrame, size: int) -> pd.DataFrame:
    """The scores with which each chunk of a text is entered, from the chunks' matrices.

    Runs of chunks are multiplied first, all runs at once; a run is entered with the product of
    those before it, and a chunk with that of its run so far.
    """
    frame = frame.sort_values("chunk")
    each = np.stack([np.frombuffer(m, np.int64).reshape(size, size) for m in frame["matrix"]])
    run = max(1, round(len(each) ** 0.5))
    unit = np.full((size, size), NEVER, dtype=np.int64)
    np.fill_diagonal(unit, 0)
    padded = np.concatenate([each, np.repeat(unit[None], -len(each) % run, axis=0)]).reshape(-1, run, size, size)
    products = padded[:, 0]
    for i in range(1, run):
        products = combine(products, padded[:, i])
    entry = np.full(size, NEVER, dtype=np.int64)
    entry[0] = 0
    out = []
    step = lambda v, m: np.maximum((v[:, None] + m).max(axis=0), NEVER)
    for product, members in zip(products, padded):
        inner = entry
        for m in members:
            out.append(inner.tobytes())
            inner = step(inner, m)
        entry = step(entry, product)
    return pd.DataFrame({"doc_id": frame["doc_id"], "tie": frame["tie"], "chunk": frame["chunk"], "entry": out[: len(frame)]})


def _chains(table: PieceTable, text: str, limit: int, entry: np.ndarray):
    """For each state at a chunk's end the state at its begin, and the pieces between: how many of
    the first chain's ids, then own ones."""
    size = table.longest
    entries = [(o, int(s)) for o, s in enumerate(entry) if s > NEVER]
    cuts = _cuts(table, text[: limit + 1])
    cuts = cuts[(cuts >= size - 1) & (cuts < limit)]
    if len(cuts):
        # All chains come to the first cut in the same way and leave the last one as they must.
        meet, last = int(cuts[0]), int(cuts[-1])
        head, visited = table.chain(text, table.forward(text, entries, meet)[1], meet)
        common = [i for ids in head for i in ids]
        middle = b"".join(ids for ids, _ in table.parts(text[meet:last]))
        _, back = table.forward(text[last:], [(0, 0)], limit - last)
        begins, length, tails = [], len(common) + len(middle) // 4, []
        for state in range(size):
            end = limit - last + state
            reached = back[end] != -1
            begins.append(visited[0] if reached else -1)
            tail = table.chain(text[last:], back, end)[0] if reached else []
            tails.append(np.array([i for ids in tail for i in ids], "<i4").tobytes())
        return begins, [length] * size, tails, np.array(common, "<i4").tobytes() + middle
    _, back = table.forward(text, entries, limit)
    first, marks = None, {}
    froms, shared, tails = [], [], []
    for state in range(size):
        end = limit + state
        if back[end] == -1:
            froms, shared, tails = froms + [-1], shared + [0], tails + [b""]
            continue
        pieces, visited = table.chain(text, back, end)
        if first is None:
            first = pieces
            counts = np.cumsum([0] + [len(p) for p in pieces])
            marks = dict(zip(visited, counts.tolist()))
        meet = max((i for i, v in enumerate(visited) if v in marks), default=None)
        whole = meet is None
        tail = pieces if whole else pieces[meet:]
        froms.append(visited[0])
        shared.append(0 if whole else marks[visited[meet]])
        tails.append(np.array([i for p in tail for i in p], "<i4").tobytes())
    ids = np.array([i for p in first or [] for i in p], "<i4").tobytes()
    return froms, shared, tails, ids


def _exits(frame: pd.DataFrame) -> pd.DataFrame:
    """The state each chunk of a text is left with: composed from the end."""
    frame = frame.sort_values("chunk")
    state, states = 0, []
    for froms in reversed(list(frame["froms"])):
        states.append(state)
        state = int(froms[state])
    return pd.DataFrame({"doc_id": frame["doc_id"], "tie": frame["tie"], "chunk": frame["chunk"], "state": states[::-1]})


def encode_long(docs: DataFrame, shared, size: int, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, tie, ids)`` of long texts ``(doc_id, tie, text)``, one row each.

    ``shared`` is the broadcast table, ``size`` the length of its longest piece.

    Every chunk is a row of its own. A text has at most 2^31 bytes in Spark, so its chunks' matrices
    and states, which are what meets in one task, are bounded by about 2^31 / ``chunk`` times 2 KB.
    """
    if chunk < size:
        raise ValueError("a chunk must be longer than any piece")

    def cut(frames):
        for frame in frames:
            for row in frame.itertuples():
                text = written(row.text)
                for k, begin in enumerate(range(0, len(text), chunk)):
                    # A lone surrogate marks the literal sign; it travels as bytes.
                    part = text[begin : begin + chunk + size].encode("utf-8", "surrogatepass")
                    limit = min(chunk, len(text) - begin)
                    yield pd.DataFrame(
                        {"doc_id": [row.doc_id], "tie": [row.tie], "chunk": [k], "limit": [limit], "part": [part]}
                    )

    def matrices(frames):
        table = _rebuilt(shared)
        for frame in frames:
            made = [transfer(table, p.decode("utf-8", "surrogatepass"), n).tobytes() for p, n in zip(frame["part"], frame["limit"])]
            yield frame[["doc_id", "tie", "chunk"]].assign(matrix=made)

    def chains(frames):
        table = _rebuilt(shared)
        for frame in frames:
            made = [
                _chains(table, p.decode("utf-8", "surrogatepass"), n, np.frombuffer(e, np.int64))
                for p, n, e in zip(frame["part"], frame["limit"], frame["entry"])
            ]
            columns = dict(zip(("froms", "shared", "tails", "ids"), zip(*made))) if made else {}
            yield frame[["doc_id", "tie", "chunk"]].assign(**{k: list(v) for k, v in columns.items()})

    key = "doc_id bigint, tie bigint, chunk int"
    parts = write_scratch(docs.mapInPandas(cut, f"{key}, limit int, part binary").repartition("doc_id", "tie", "chunk"), "chunks")
    on = ["doc_id", "tie", "chunk"]
    scored = parts.mapInPandas(matrices, f"{key}, matrix binary")
    entries = scored.groupBy("doc_id", "tie").applyInPandas(lambda f: _states(f, size), f"{key}, entry binary")
    entries = write_scratch(entries, "entries")
    linked = parts.join(entries, on).mapInPandas(
        chains, f"{key}, froms array<int>, shared array<int>, tails array<binary>, ids binary"
    )
    linked = write_scratch(linked, "chains")
    exits = linked.select(*on, "froms").groupBy("doc_id", "tie").applyInPandas(_exits, f"{key}, state int")

    def whole(frames):
        for frame in frames:
            made = [
                np.frombuffer(ids[: 4 * shared[s]] + tails[s], "<i4")
                for ids, shared, tails, s in zip(frame["ids"], frame["shared"], frame["tails"], frame["state"])
            ]
            yield frame[["doc_id", "tie", "chunk"]].assign(ids=made)

    chosen = linked.join(write_scratch(exits, "exits"), on).mapInPandas(whole, f"{key}, ids array<int>")
    ordered = F.sort_array(F.collect_list(F.struct("chunk", "ids")))
    return chosen.groupBy("doc_id", "tie").agg(F.flatten(F.transform(ordered, lambda c: c["ids"])).alias("ids"))


def encode_documents(docs: DataFrame, table: PieceTable, chunk: int = CHUNK) -> DataFrame:
    """The columns of ``docs`` but for ``text``, with ``ids``, ``n_pieces`` and ``decoded``.

    ``decoded`` is whether the ids, decoded, give back the text. Texts of more than ``chunk``
    characters are encoded in chunks, the others in one piece; the ids are those of the whole text
    either way. A null text counts as empty; an empty text has no ids. Rows of equal id and text
    are encoded alike; an empty table gives an empty result. Columns of these names that ``docs``
    has are replaced. Rows need a ``doc_id``, which may be null or repeated.
    """
    keep = [c for c in docs.columns if c not in ("text", "ids", "n_pieces", "decoded")]
    shared = shared_table(docs.sparkSession, table)
    out = T.StructType([*docs.select(*keep).schema.fields, *_RESULT.fields])

    def whole(batches):
        table = _rebuilt(shared)
        for part in _parts_of(batches):
            texts = part.column(len(keep)).to_pylist()
            yield _with_ids(part, len(keep), table.encode_all(texts), texts, table)

    length = F.coalesce(F.length("text"), F.lit(0))
    rows = docs.select(*keep, "text")
    short = rows.filter(length <= chunk).mapInArrow(whole, out)
    long = rows.filter(length > chunk).withColumns(
        {"__id": F.coalesce(docs["doc_id"].cast("bigint"), F.lit(-1)), "__tie": F.xxhash64("text")}
    )
    once = long.select(F.col("__id").alias("doc_id"), F.col("__tie").alias("tie"), "text").dropDuplicates(["doc_id", "tie"])
    found = write_scratch(encode_long(once, shared, table.longest, chunk), "long-ids")

    def rejoined(batches):
        table = _rebuilt(shared)
        for part in _parts_of(batches):
            ids = [np.array(i, "<i4") for i in part.column(len(keep) + 1).to_pylist()]
            yield _with_ids(part, len(keep), ids, part.column(len(keep)).to_pylist(), table)

    found = found.select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.col("ids").alias("__ids"))
    joined = long.join(found, ["__id", "__tie"]).select(*keep, "text", "__ids")
    return short.unionByName(joined.mapInArrow(rejoined, out))


def decode_documents(encoded: DataFrame, table: PieceTable, chunk: int = CHUNK) -> DataFrame:
    """The columns of ``encoded`` but for ``ids``, with the ``text`` that its piece ids stand for.

    ``ids`` is an array of ints, as ``encode_documents`` returns or has stored them. Ids are turned
    into bytes ``chunk`` at a time and read as UTF-8 once joined, so a cut may lie within a
    character that is written as bytes. No ids, or null, give an empty text; an id that the table
    does not have, or bytes that are no UTF-8, which no text is encoded to, give null. A column
    ``text`` of ``encoded`` is replaced; repeated rows are decoded alike; an empty table gives an
    empty result.
    """
    keep = [c for c in encoded.columns if c not in ("text", "ids")]
    shared = shared_table(encoded.sparkSession, table)
    out = T.StructType([*encoded.select(*keep).schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        table = _rebuilt(shared)
        for part in _parts_of(batches):
            lists = part.column(len(keep))
            texts = [_text_of(table, lists[i].values, chunk) for i in range(len(lists))]
            columns = [*part.columns[: len(keep)], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, out.names)

    return encoded.select(*keep, "ids").mapInArrow(run, out)


def _text_of(table: PieceTable, ids: pa.Array | None, chunk: int) -> str | None:
    known, parts = table.written, []
    for at in range(0, len(ids) if ids is not None else 0, chunk):
        part = ids.slice(at, chunk).to_pylist()
        if any(i is None or not 0 <= i < len(known) for i in part):
            return None
        parts.append(b"".join([known[i] for i in part]))
    try:
        return b"".join(parts)[1:].decode("utf-8")
    except UnicodeDecodeError:
        return None


def _parts_of(batches, rows: int = 256):
    """Batches in short parts, so that few results are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_RESULT = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("n_pieces", T.LongType()),
        T.StructField("decoded", T.BooleanType()),
    ]
)


def _with_ids(part, n_columns: int, ids, texts, table: PieceTable):
    """The first columns of a part with the results for its texts."""
    lengths = np.array([len(i) for i in ids], dtype=np.int64)
    offsets = pa.array(np.concatenate([[0], lengths.cumsum()]), pa.int32())
    flat = np.concatenate(ids).astype(np.int32, copy=False) if ids else np.zeros(0, np.int32)
    listed = pa.ListArray.from_arrays(offsets, pa.array(flat))
    same = [table.decode(i.tolist()) == (t or "") for i, t in zip(ids, texts)]
    columns = [*part.columns[:n_columns], listed, pa.array(lengths), pa.array(same, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, [*part.schema.names[:n_columns], "ids", "n_pieces", "decoded"])
