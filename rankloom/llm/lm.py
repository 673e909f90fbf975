"""Language-model scoring with a causal self-attention model over subword ids, trained in numpy.

Words are cut into subwords of a given public vocabulary.  One attention layer with a bias for each
distance and one feed-forward layer see the preceding subwords; the next one is predicted in two
steps, its class and its place in the class, over the SYMBOLS most frequent subwords of all training
documents.  The other subwords are one symbol, shared out by their counts.  Texts are scored in
windows that overlap by half: the first half is context, each subword is scored once.  A word's
probability is that of its subwords, mixed with its frequency among the LEXICON most frequent words.

Beside the model's, every text gets the score of a smoothed word-unigram over all training documents.
The counts come from one pass: words of a few MB of documents are counted there and dealt by hash, and
each group sums its words' counts and gives back the part of each document's score that it holds.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import bounded_rows, fold_hash, materialize, slices, spread, table
from .suffixes import keyed

FOLDS, HELD_OUT = 7, 2
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: rounds of training over parts of the documents that together hold each one once
ROUNDS = 4
#: a table of fewer subwords is passed over up to MAX_PASSES times
FEW_SUBWORDS, MAX_PASSES = 3_000_000, 3
#: windows that a task shuffles and takes its steps from, and windows of a step
POOL, STEP = 8192, 64
#: least steps of a task in a round; a small table trains in fewer tasks, so that averaging does not starve it of steps
LEAST_STEPS = 100
#: one in SHARES training documents fits the lexicon's share instead of the model
SHARES = 50
CLASSES, PER_CLASS = 64, 64
SYMBOLS = CLASSES * PER_CLASS
WIDTH, HIDDEN, SPAN = 32, 32, 32
HALF = SPAN // 2
#: windows scored at once
BLOCKS = 512
GROUP_BYTES = 32 << 20
UNIT = 4 << 20
#: words mixed in by their frequency; their hashes and counts travel to every task
LEXICON = 50_000
_CACHE = 300_000
_WORD_LIMIT = 64


def read_ranks(path: str) -> dict:
    """Subwords and their ranks from a vocabulary file; read on the driver, under 2 MB."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class _Numbers(dict):
    """Words and their numbers, given when a word is first asked for; ``new`` holds the words numbered since it was emptied."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.new.append(word)
        return number


def _appended(held: np.ndarray, used: int, more) -> np.ndarray:
    """``held`` with ``more`` behind its first ``used`` values; its room doubles, so that few calls copy it."""
    size = used + len(more)
    if size > len(held):
        grown = np.empty(max(size, 2 * len(held)), held.dtype)
        grown[:used] = held[:used]
        held = grown
    held[used:size] = more
    return held


class Subwords:
    """Words to subword ids; every word is cut by itself and kept, with a number of its own."""

    def __init__(self, ranks: dict):
        import tiktoken

        self.end = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding(
            "words", pat_str=f"(?s:.{{1,{_WORD_LIMIT}}})", mergeable_ranks=ranks, special_tokens={"<|end|>": self.end}
        )
        self._clear()

    def _clear(self) -> None:
        self.place, self.used = _Numbers(), 0
        # with room behind the values of the words so far
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, word: bytes) -> list:
        return self.encoding.encode_ordinary(" " + word.decode("utf-8", "replace"))

    def numbers(self, words: list) -> tuple:
        """(number of each word, the words that are new since the last call)."""
        if len(self.place) > _CACHE:
            self._clear()
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        new, self.place.new = self.place.new, []
        if new:
            parts, known = [self.encode(w) for w in new], len(self.place) - len(new)
            size = np.array([len(x) for x in parts], np.int64)
            self.start = _appended(self.start, known, self.used + np.cumsum(size) - size)
            self.size = _appended(self.size, known, size)
            self.flat = _appended(self.flat, self.used, [i for x in parts for i in x])
            self.used += int(size.sum())
        return at, new

    def spell(self, at: np.ndarray) -> np.ndarray:
        """Subword ids of numbered words, one after another."""
        size = self.size[at]
        return self.flat[np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def ids(self, words: list) -> np.ndarray:
        return self.spell(self.numbers(words)[0])


class Symbols:
    """The most frequent subwords as symbols (0: all others), with the others' shares of symbol 0."""

    def __init__(self, counts: np.ndarray, end: int):
        # symbol 0 stands for all rare subwords; the end of a text is always a symbol
        boosted = counts.astype(float)
        boosted[end] = np.inf
        frequent = np.argsort(-boosted, kind="stable")[: SYMBOLS - 1]
        self.of = np.zeros(len(counts), np.int32)
        self.of[frequent] = np.arange(1, SYMBOLS)
        rare = np.ones(len(counts), bool)
        rare[frequent] = False
        total = counts[rare].sum() + rare.sum()
        self.share = np.where(rare, np.log((counts + 1.0) / max(total, 1)), 0.0)
        known = np.concatenate([[counts[rare].sum()], counts[frequent]]) + 0.5
        self.log_unigram = np.log(known / known.sum())
        self.end = int(self.of[end])


class Attention:
    """Parameters as a dict of arrays; symbol SYMBOLS marks the beginning of a text."""

    def __init__(self, log_unigram: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        classes = np.exp(log_unigram).reshape(CLASSES, PER_CLASS)
        own = np.log(classes.sum(axis=1))

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "E": normal(SYMBOLS + 1, WIDTH, scale=0.3), "R": np.linspace(1, -1, SPAN).astype(np.float32),
            "Q": normal(WIDTH, WIDTH, scale=WIDTH**-0.5), "K": normal(WIDTH, WIDTH, scale=WIDTH**-0.5),
            "V": normal(WIDTH, WIDTH, scale=WIDTH**-0.5), "O": normal(WIDTH, WIDTH, scale=0.5 * WIDTH**-0.5),
            "A": normal(WIDTH, HIDDEN, scale=WIDTH**-0.5), "a": np.zeros(HIDDEN, np.float32),
            "B": normal(HIDDEN, WIDTH, scale=0.5 * HIDDEN**-0.5),
            "C": normal(WIDTH, CLASSES, scale=0.05), "c": own.astype(np.float32),
            "M": normal(CLASSES, WIDTH, PER_CLASS, scale=0.05),
            "m": (log_unigram.reshape(CLASSES, PER_CLASS) - own[:, None]).astype(np.float32),
        }

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x -= x.max(axis=-1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=-1, keepdims=True)
        return x

    def train(self, pools, rate: float = 6e-3, batch: int = STEP, warm: int = 20) -> int:
        """Adam over pools of windows of SPAN inputs and their next symbols (-1: none); gives the number of symbols."""
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        room = {k: np.empty_like(v) for k, v in self.p.items()}  # arrays of this size are slow to allocate in each step
        rng = np.random.default_rng(11)
        step, total = 0, 0
        for windows, targets in pools:
            order = rng.permutation(len(windows))
            total += int((targets >= 0).sum())
            for start in range(0, len(order), batch):
                own = order[start:start + batch]
                gradients = self._gradients(windows[own], targets[own])
                # a rest of few windows moves the parameters by its share of a step
                now = rate * min(1.0, (step + 1) / warm) * len(own) / batch
                for k, g in gradients.items():
                    (first, second), held = state[k], room[k]
                    np.subtract(g, first, out=held)
                    held *= 0.1
                    first += held
                    np.multiply(g, g, out=g)
                    g -= second
                    g *= 0.02
                    second += g
                    np.divide(first, 1 - 0.9 ** (step + 1), out=held)
                    held *= now
                    np.divide(second, 1 - 0.98 ** (step + 1), out=g)
                    np.sqrt(g, out=g)
                    g += 1e-8
                    held /= g
                    self.p[k] -= held
                step += 1
        return total

    def flat(self) -> np.ndarray:
        """All parameters as one array of doubles."""
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(float)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at:at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def _gradients(self, inputs: np.ndarray, targets: np.ndarray) -> dict:
        p = self.p
        many, size = inputs.shape
        distance = np.arange(size)[:, None] - np.arange(size)[None, :]
        bias = np.where(distance >= 0, p["R"][np.maximum(distance, 0)], -1e9).astype(np.float32)
        x = p["E"][inputs]
        q, k, v = x @ p["Q"], x @ p["K"], x @ p["V"]
        scale = np.float32(WIDTH**-0.5)
        w = self._softmax(q @ k.transpose(0, 2, 1) * scale + bias)
        o = w @ v
        h = x + o @ p["O"]
        f = np.maximum(h @ p["A"] + p["a"], 0)
        y = (h + f @ p["B"]).reshape(-1, WIDTH)
        flat = targets.ravel()
        good = np.flatnonzero(flat >= 0)
        kind, place = np.divmod(flat[good], PER_CLASS)
        yg = y[good]
        n = np.float32(max(1, len(good)))
        dy = np.zeros_like(y)
        pc = self._softmax(yg @ p["C"] + p["c"])
        pc[np.arange(len(good)), kind] -= 1
        pc /= n
        dyg = pc @ p["C"].T
        g = {"C": yg.T @ pc, "c": pc.sum(axis=0), "M": np.zeros_like(p["M"]), "m": np.zeros_like(p["m"])}
        order = np.argsort(kind, kind="stable")
        edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        # symbols of a class follow each other, so only the products are taken class by class
        ys, pm, back = yg[order], np.empty((len(good), PER_CLASS), yg.dtype), np.empty_like(yg)
        classes = [(c, slice(edges[c], edges[c + 1])) for c in np.flatnonzero(np.diff(edges))]
        for c, own in classes:
            np.matmul(ys[own], p["M"][c], out=pm[own])
        pm += p["m"][kind[order]]
        self._softmax(pm)
        pm[np.arange(len(good)), place[order]] -= 1
        pm /= n
        for c, own in classes:
            np.matmul(ys[own].T, pm[own], out=g["M"][c])
            pm[own].sum(axis=0, out=g["m"][c])
            np.matmul(pm[own], p["M"][c].T, out=back[own])
        dyg[order] += back
        dy[good] = dyg
        dy = dy.reshape(many, size, WIDTH)
        f2, dy2 = f.reshape(-1, HIDDEN), dy.reshape(-1, WIDTH)
        g["B"] = f2.T @ dy2
        df = (dy @ p["B"].T) * (f > 0)
        g["A"] = h.reshape(-1, WIDTH).T @ df.reshape(-1, HIDDEN)
        g["a"] = df.sum(axis=(0, 1))
        dh = dy + df @ p["A"].T
        g["O"] = o.reshape(-1, WIDTH).T @ dh.reshape(-1, WIDTH)
        do = dh @ p["O"].T
        dv = w.transpose(0, 2, 1) @ do
        dw = do @ v.transpose(0, 2, 1)
        ds = w * (dw - (dw * w).sum(axis=-1, keepdims=True))
        g["R"] = np.bincount(np.maximum(distance, 0).ravel(), (ds.sum(axis=0) * (distance >= 0)).ravel(), SPAN).astype(np.float32)
        ds *= scale
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        x2 = x.reshape(-1, WIDTH)
        for name, d in (("Q", dq), ("K", dk), ("V", dv)):
            g[name] = x2.T @ d.reshape(-1, WIDTH)
        dx = (dh + dq @ p["Q"].T + dk @ p["K"].T + dv @ p["V"].T).reshape(-1, WIDTH)
        order = np.argsort(inputs.ravel(), kind="stable")
        ids = inputs.ravel()[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        g["E"] = np.zeros_like(p["E"])
        g["E"][ids[first]] = np.add.reduceat(dx[order], first)
        return g

    def prepare(self) -> None:
        """Queries, keys and values of every symbol; with one layer they depend on nothing else."""
        p, scale = self.p, np.float32(WIDTH**-0.5)
        self.q, self.k, self.v = p["E"] @ p["Q"] * scale, p["E"] @ p["K"], p["E"] @ p["V"] @ p["O"]
        distance = np.arange(HALF)[:, None] + HALF - np.arange(SPAN)[None, :]
        self.bias = np.where(distance >= 0, p["R"][np.clip(distance, 0, SPAN - 1)], -1e9).astype(np.float32)

    def log_chances(self, texts: list) -> np.ndarray:
        """Natural log-probabilities of the symbols of all texts, one after another."""
        sizes = np.array([len(t) for t in texts])
        blocks = -(-sizes // HALF)
        # every text: HALF pads, the beginning, its symbols; pads at the end fill the last block
        room = (blocks + 1) * HALF
        offset = np.cumsum(room) - room
        line = np.full(int(room.sum()), -1, np.int32)
        goal = np.full(int(room.sum()), -1, np.int32)
        for t, at in zip(texts, offset):
            line[at + HALF] = SYMBOLS
            line[at + HALF + 1:at + HALF + len(t)] = t[:-1]
            goal[at + HALF:at + HALF + len(t)] = t
        start = np.repeat(offset - (np.cumsum(blocks) - blocks) * HALF, blocks) + np.arange(blocks.sum()) * HALF
        out = []
        for i in range(0, len(start), BLOCKS):
            at = start[i:i + BLOCKS, None]
            out.append(self._block(line[at + np.arange(SPAN)], goal[at + np.arange(HALF, SPAN)]))
        return np.concatenate(out)

    def _block(self, inputs: np.ndarray, goals: np.ndarray) -> np.ndarray:
        """Log-probabilities of the symbols in the second halves of windows."""
        p = self.p
        real = np.maximum(inputs, 0)
        now = real[:, HALF:]
        w = np.take(self.q, now, axis=0) @ np.take(self.k, real, axis=0).transpose(0, 2, 1)
        w += self.bias
        if (inputs[:, :HALF] < 0).any():
            w += np.where(inputs < 0, np.float32(-1e9), np.float32(0))[:, None, :]
        np.exp(np.minimum(w, 60, out=w), out=w)
        o = w @ np.take(self.v, real, axis=0)
        o /= np.maximum(w.sum(axis=-1, keepdims=True), np.float32(1e-30))
        flat = goals.ravel()
        good = np.flatnonzero(flat >= 0)
        h = p["E"][now.ravel()[good]] + o.reshape(-1, WIDTH)[good]
        y = h + np.maximum(h @ p["A"] + p["a"], 0) @ p["B"]
        kind, place = np.divmod(flat[good], PER_CLASS)
        logit = y @ p["C"] + p["c"]
        score = logit[np.arange(len(good)), kind] - _log_sum(logit)
        order = np.argsort(kind, kind="stable")
        y, kind, place = y[order], kind[order], place[order]
        edges = np.searchsorted(kind, np.arange(CLASSES + 1))
        logit = p["m"][kind]
        for c in np.flatnonzero(np.diff(edges)):
            logit[edges[c]:edges[c + 1]] += y[edges[c]:edges[c + 1]] @ p["M"][c]
        score[order] += logit[np.arange(len(good)), place] - _log_sum(logit)
        return score


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials of each line of logits, which are far from the limits of floats; ``x`` is lost."""
    return np.log(np.exp(np.minimum(x, 80, out=x), out=x).sum(axis=1))


class Scorer:
    """Subwords, model and lexicon (hash of a word: natural log of its frequency) of one task."""

    def __init__(self, ranks: dict, symbols: Symbols, model: Attention, lexicon: dict, end: float, share: float = 0.5):
        self.subwords, self.symbols, self.model = Subwords(ranks), symbols, model
        self.lexicon, self.end, self.share = lexicon, end, share
        self.known = np.zeros(0)
        model.prepare()

    def parts(self, texts: list) -> tuple:
        """(text number, spelled, in the lexicon): natural logs for every word and, last of a text, its end."""
        words = [w for text in texts for w in text]
        at, new = self.subwords.numbers(words)
        if len(self.subwords.place) == len(new):
            self.known = np.zeros(0)
        get = self.lexicon.get
        self.known = np.concatenate([self.known, [get(xxhash.xxh64_intdigest(w), -np.inf) for w in new]])
        many = np.array([len(text) for text in texts], np.int64)
        ids, size = self.subwords.spell(at), self.subwords.size[at]
        # the end follows the last subword of each text
        of_text = np.repeat(np.arange(len(texts)), many)
        long = np.bincount(of_text, size, len(texts)).astype(np.int64)
        ends = np.cumsum(long + 1) - 1
        inner = np.ones(len(ids) + len(texts), bool)
        inner[ends] = False
        line = np.empty(len(inner), np.int32)
        line[inner], line[ends] = self.symbols.of[ids], self.symbols.end
        logs = self.model.log_chances(np.split(line, ends[:-1] + 1)) if len(texts) else np.zeros(0)
        spelled = np.bincount(np.repeat(np.arange(len(at)), size), logs[inner] + self.symbols.share[ids], len(at))
        return (
            np.concatenate([of_text, np.arange(len(texts))]), np.concatenate([spelled, logs[ends]]),
            np.concatenate([self.known[at], np.full(len(texts), self.end)]),
        )

    def log10(self, texts: list) -> np.ndarray:
        """log10 probability of each text, given as its words."""
        text, spelled, known = self.parts(texts)
        mixed = np.logaddexp(np.log(self.share) + known, np.log1p(-self.share) + spelled)
        return np.bincount(text, mixed, len(texts)) / np.log(10)


# --- counts of all training documents -------------------------------------------------------------


def _pack(*arrays) -> bytes:
    head = np.array([x.nbytes for x in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(x.tobytes() for x in arrays))


def _unpack(blob: bytes, kinds: tuple) -> list:
    data = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(kinds), []
    for kind, size in zip(kinds, np.frombuffer(data, np.int64, len(kinds))):
        out.append(np.frombuffer(data[at:at + size], kind))
        at += size
    return out


_KINDS = (np.uint64, np.int64, np.uint32, np.uint32, np.uint32, np.int64, np.int64)


def _count(groups: int, ranks: dict):
    """For each few MB of text and each group of words: the words' hashes and counts, and each document's uses."""

    def units(batches):
        held, size = [], 0
        for batch, found in slices(batches):
            for id_, slot, trains, text in zip(
                batch.column("_id").to_numpy(), batch.column("_slot").to_numpy(), batch.column("trains").to_pylist(), found
            ):
                held.append((id_, slot, trains, text))
                size += len(text)
                if size >= UNIT:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def count(batches):
        subwords = Subwords(ranks)
        totals = np.zeros(subwords.end + 1, np.int64)
        for serial, unit in enumerate(units(batches)):
            place: dict = {}
            docs, words, uses, trained = [], [], [], []
            for n, (_, _, trains, text) in enumerate(unit):
                found, many = np.unique(
                    np.array([place.setdefault(w, len(place)) for w in text.lower().split()], np.int64), return_counts=True
                )
                docs.append(np.full(len(found), n, np.uint32))
                words.append(found)
                uses.append(many)
                trained.append(many if trains else np.zeros(len(many), np.int64))
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in place], np.uint64)
            docs, words, uses, trained = (np.concatenate(x) for x in (docs, words, uses, trained))
            counts = np.bincount(words, trained, len(place)).astype(np.int64)
            at, _ = subwords.numbers(list(place))
            totals += np.bincount(subwords.spell(at), np.repeat(counts, subwords.size[at]), len(totals)).astype(np.int64)
            totals[subwords.end] += sum(1 for x in unit if x[2])
            ids = np.array([x[0] for x in unit], np.int64)
            slots = np.array([x[1] for x in unit], np.int64)
            group = (hashes >> np.uint64(40)) % np.uint64(groups)
            of_use = group[words] if len(words) else np.zeros(0, np.uint64)
            out_group, out_blob = [], []
            number_of_unit = TaskContext.get().partitionId() << 32 | serial
            for g in np.unique(group):
                own = np.flatnonzero(group == g)
                number = np.zeros(len(place), np.uint32)
                number[own] = np.arange(len(own))
                use = np.flatnonzero(of_use == g)
                held, of_doc = np.unique(docs[use], return_inverse=True)
                out_group.append(int(g))
                out_blob.append(_pack(
                    hashes[own], counts[own], number[words[use]], of_doc.astype(np.uint32),
                    uses[use].astype(np.uint32), ids[held], slots[held],
                ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_group, pa.int32()), pa.array([number_of_unit] * len(out_group), pa.int64()), pa.array(out_blob, pa.binary())],
                ["grp", "unit", "blob"],
            )
        # the subword counts of a task are one row of a group of their own
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([_pack(totals)], pa.binary())], ["grp", "unit", "blob"]
        )

    return count


def _sum_up():
    """Sum the words of a group; give back, packed for each unit, what they add to its documents."""

    def rows(units, hashes, counts, blobs):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip((units, hashes, counts, blobs), kinds)], ["unit", "hash", "n", "blob"]
        )

    def settle(units, blobs):
        parts = [_unpack(b, _KINDS) for b in blobs]
        hashes, inverse = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([x[1] for x in parts]), len(hashes)).astype(np.int64)
        logs, known = np.log10(counts + 1), counts > 0
        at = 0
        for unit, x in zip(units, parts):
            of_word = inverse[at:at + len(x[0])][x[2]]
            at += len(x[0])
            many = len(x[5])
            sums = np.bincount(x[3], x[4] * logs[of_word], many), np.bincount(x[3], x[4] * known[of_word], many).astype(np.int64)
            yield rows([unit], [None], [None], [_pack(x[5], x[6], *sums)])
        # rows without a unit: the number of distinct words, and the most frequent words by their hashes
        yield rows([None], [None], [int(known.sum())], [None])
        top = np.flatnonzero(known)
        top = top[np.argsort(-counts[top], kind="stable")[:LEXICON]]
        yield rows([None] * len(top), hashes[top].view(np.int64), counts[top], [None] * len(top))

    def settle_all(batches):
        current, units, blobs = None, [], []
        for batch in batches:
            for group, unit, blob in zip(*(batch.column(n) for n in ("grp", "unit", "blob"))):
                if group.as_py() != current and blobs:
                    yield from settle(units, blobs)
                    units, blobs = [], []
                current = group.as_py()
                units.append(unit.as_py())
                blobs.append(blob.as_py())
        if blobs:
            yield from settle(units, blobs)

    return settle_all


def _join_up(batches):
    """(_id, _slot, logs, known) of every document from the packed sums of its unit, which follow one another."""

    def settle(parts):
        ids, slots, logs, known = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((slots, ids))
        ids, slots = ids[order], slots[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (slots[1:] != slots[:-1])
        first = np.flatnonzero(fresh)
        if len(first):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[first]), pa.array(slots[first]), pa.array(np.add.reduceat(logs[order], first)),
                 pa.array(np.add.reduceat(known[order], first))], ["_id", "_slot", "logs", "known"],
            )

    current, parts = None, []
    for batch in batches:
        for unit, blob in zip(batch.column("unit"), batch.column("blob")):
            if unit.as_py() != current and parts:
                yield from settle(parts)
                parts = []
            current = unit.as_py()
            parts.append(_unpack(blob.as_py(), (np.int64, np.int64, np.float64, np.int64)))
    if parts:
        yield from settle(parts)


def _subword_counts(dealt: DataFrame, size: int) -> np.ndarray:
    """Sum the tasks' subword counts; the result has one number for each entry of the vocabulary."""

    def unfold(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                counts = _unpack(blob, (np.int64,))[0]
                ids = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts[ids])], ["id", "n"])

    found = dealt.filter("grp = -1").mapInArrow(unfold, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


# --- training and scoring ---------------------------------------------------------------------------


def windows_of(symbols: Symbols, ids: np.ndarray) -> tuple:
    """All windows of SPAN inputs of one whole text, given by its subwords, and their next symbols (-1: none)."""
    line = np.concatenate([[SYMBOLS], symbols.of[ids], [symbols.end]]).astype(np.int32)
    many = -(-(len(line) - 1) // SPAN)
    inputs, goals = np.zeros(many * SPAN, np.int32), np.full(many * SPAN, -1, np.int32)
    inputs[: len(line) - 1], goals[: len(line) - 1] = line[:-1], line[1:]
    return inputs.reshape(many, SPAN), goals.reshape(many, SPAN)


def _pools(batches, subwords: Subwords, symbols: Symbols):
    """Windows of whole texts, cut into pools of at most POOL."""
    inputs, goals, size = [], [], 0
    for _, found in slices(batches):
        for text in found:
            x, y = windows_of(symbols, subwords.ids(text.lower().split()))
            for start in range(0, len(x), POOL):
                inputs.append(x[start:start + POOL])
                goals.append(y[start:start + POOL])
                size += len(inputs[-1])
                if size >= POOL:
                    yield np.concatenate(inputs), np.concatenate(goals)
                    inputs, goals, size = [], [], 0
    if size:
        yield np.concatenate(inputs), np.concatenate(goals)


_PIECE = 1 << 14


def _trained(ranks: dict, symbols: Symbols, model: Attention, rate: float, warm: int):
    """A task's parameters after its documents, in pieces and times the number of its symbols."""

    def run(batches):
        total = model.train(_pools(batches, Subwords(ranks), symbols), rate, warm=warm)
        flat = model.flat() * total
        for piece in range(-(-len(flat) // _PIECE) if total else 0):
            part = flat[piece * _PIECE:(piece + 1) * _PIECE]
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece], pa.int32()), pa.array([total], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["piece", "n", "sums"]
            )

    return run


def _add_up(batches):
    sums: dict = {}
    for batch in batches:
        for piece, n, blob in zip(*(batch.column(c).to_pylist() for c in ("piece", "n", "sums"))):
            held = sums.get(piece)
            part = np.frombuffer(blob)
            sums[piece] = (held[0] + n, held[1] + part) if held else (n, part)
    for piece, (n, part) in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([piece], pa.int32()), pa.array([n], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["piece", "n", "sums"]
        )


def _round(texts: DataFrame, ranks: dict, symbols: Symbols, model: Attention, rate: float, warm: int) -> int:
    """Train on all partitions of ``texts`` at once from the same parameters, then take their weighted mean."""
    schema = "piece int, n long, sums binary"
    rows = texts.mapInArrow(_trained(ranks, symbols, model, rate, warm), schema).repartition("piece").mapInArrow(_add_up, schema).toArrow()
    if not len(rows):
        return 0
    rows = rows.sort_by("piece")
    model.load(np.concatenate([np.frombuffer(b) for b in rows.column("sums").to_pylist()]) / rows.column("n")[0].as_py())
    return rows.column("n")[0].as_py()


#: logarithmic differences between lexicon and model are counted in bins of 1/64
_BINS, _FINE = 8192, 64


def _differences(scorer_of):
    def run(batches):
        scorer, counts = scorer_of(), np.zeros(_BINS + 1, np.int64)
        for _, found in slices(batches):
            _, spelled, known = scorer.parts([text.lower().split() for text in found])
            d = np.where(np.isfinite(known), known - spelled, -np.inf)
            bins = np.where(np.isfinite(d), np.clip(np.floor(np.where(np.isfinite(d), d, 0) * _FINE) + _BINS // 2, 0, _BINS - 1), _BINS)
            counts += np.bincount(bins.astype(np.int64), minlength=_BINS + 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["bin", "n"])

    return run


def _fit_share(texts: DataFrame, scorer_of, rounds: int = 12) -> float:
    """The lexicon's share, by expectation and maximisation on whole texts that did not train the model."""
    found = texts.mapInArrow(_differences(scorer_of), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toArrow()
    bins, n = found.column("bin").to_numpy(), found.column("n").to_numpy()
    ratio = np.where(bins == _BINS, 0.0, np.exp((bins - _BINS // 2 + 0.5) / _FINE))
    share = 0.5
    for _ in range(rounds if len(n) else 0):
        share = float(np.clip((n * (share * ratio / (share * ratio + 1 - share))).sum() / n.sum(), 0.02, 0.98))
    return share


def train(texts: DataFrame, ranks: dict, counts: np.ndarray, lexicon: dict, end: float) -> tuple:
    """(symbols, model, lexicon's share), learnt from all ``texts``, whole, in their tasks.

    Each round every task starts from the same parameters, takes Adam steps over its documents of the
    round, and the tasks' parameters are averaged by their numbers of symbols. The rounds of a pass
    share the documents out by a hash, so each document trains once a pass.
    """
    last = max(ranks.values()) + 1
    symbols = Symbols(counts, last)
    model = Attention(symbols.log_unigram)
    lot = F.pmod(F.xxhash64("_id", "_slot", F.lit(7)), F.lit(SHARES * ROUNDS))
    passes = max(1, min(MAX_PASSES, FEW_SUBWORDS // max(int(counts.sum()), 1)))
    tasks = max(1, int(counts.sum()) // (SPAN * STEP * ROUNDS * LEAST_STEPS))
    if tasks < texts.rdd.getNumPartitions():
        texts = texts.coalesce(tasks)
    rounds = ROUNDS if tasks > 1 else 1
    for number in range(passes * rounds):
        own = texts.filter((lot % SHARES != 0) & (F.floor(lot / SHARES) % rounds == number % rounds))
        # later rounds start from trained parameters
        _round(own, ranks, symbols, model, 6e-3 * (1 - 0.9 * number / (passes * rounds)), 1 if number else 20)
    share = _fit_share(texts.filter(lot % SHARES == 0), lambda: Scorer(ranks, symbols, model, lexicon, end))
    return symbols, model, share


def _lexicon(parts: DataFrame, ends: int) -> tuple:
    """({hash: log frequency} of the LEXICON most frequent training words, that of the end)."""
    top = parts.filter("hash IS NOT NULL").select("hash", "n").orderBy(F.desc("n"), "hash").limit(LEXICON).toArrow()
    counts = top.column("n").to_numpy().astype(float)
    total = counts.sum() + ends
    logs = np.log(np.append(counts, max(ends, 1e-9)) / max(total, 1))
    return dict(zip(top.column("hash").to_numpy().view(np.uint64).tolist(), logs[:-1].tolist())), float(logs[-1])


def score(docs: DataFrame, tokenizer: str = TOKENIZER, max_rows: int | None = None, max_subwords: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32(doc_id) mod 7 is not 2 train: all of them count for the word and subword counts
    and fit the attention model, each as a whole. Only a caller that asks for it, by ``max_rows`` documents
    or ``max_subwords`` subwords, gets a model of about that many, chosen by a hash. Null and empty texts consist
    of their end. Words are separated by ASCII white space and A-Z is folded. Equal rows get equal
    scores; an empty table gives an empty result, and without training rows the model is uniform
    but for its initial weights.
    """
    ranks = read_ranks(tokenizer)
    rows = spread(keyed(docs.select("doc_id", "text")), "_id").withColumn("trains", fold_hash("doc_id", FOLDS) != HELD_OUT)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-size // GROUP_BYTES))
    dealt = materialize(rows.select("_id", "_slot", "trains", "text").mapInArrow(_count(groups, ranks), "grp int, unit long, blob binary"), "counts")
    end = max(ranks.values()) + 1
    counts = _subword_counts(dealt, end + 1)
    width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(groups, 20_000))
    parts = dealt.filter("grp >= 0").repartition(width, "grp").sortWithinPartitions("grp").mapInArrow(
        _sum_up(), "unit long, hash long, n long, blob binary"
    )
    parts = materialize(parts, "parts")
    ends = rows.filter("trains").count()
    learnt = rows.filter("trains").select("_id", "_slot", "text")
    if max_subwords is not None and counts.sum() > max_subwords:
        bound = max(1, int(ends * max_subwords / counts.sum()))
        max_rows = bound if max_rows is None else min(bound, max_rows)
    if max_rows is not None:
        learnt = bounded_rows(learnt, F.col("_id"), max_rows)
    lexicon, end_log = _lexicon(parts, ends)
    symbols, model, share = train(learnt, ranks, counts, lexicon, end_log)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        scorer = Scorer(ranks, symbols, model, lexicon, end_log, share)
        for batch, found in slices(batches):
            words = [text.lower().split() for text in found]
            many = pa.array([len(w) + 1 for w in words], pa.int64())
            names = ["doc_id", "_id", "_slot", "trains"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), many, pa.array(scorer.log10(words))], [*names, "n_tokens", "score"]
            )

    scored = materialize(rows.select("doc_id", "_id", "_slot", "trains", "text").mapInArrow(
        apply, f"doc_id {kind}, _id long, _slot long, trains boolean, n_tokens long, score double"
    ), "scored")
    tokens = scored.filter("trains").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    words = parts.filter("unit IS NULL AND hash IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    distinct = words + (1 if ends else 0)
    sums = parts.filter("unit IS NOT NULL").select("unit", "blob").repartition(width, "unit").sortWithinPartitions("unit")
    of_doc = sums.mapInArrow(_join_up, "_id long, _slot long, logs double, known long").groupBy("_id", "_slot").agg(F.sum("logs").alias("logs"), F.sum("known").alias("known"))
    # rows that agree in id and text have each added the same parts
    twins = scored.groupBy("_id", "_slot").agg(F.count("*").alias("twins"))
    of_doc = of_doc.join(twins, ["_id", "_slot"]).select(
        "_id", "_slot", (F.col("logs") / F.col("twins")).alias("logs"), (F.col("known") / F.col("twins")).cast("long").alias("known")
    )
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return scored.join(of_doc, ["_id", "_slot"], "left").select(
        "doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", (known + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (logs + float(np.log10(ends + 1)) - F.col("n_tokens") * float(np.log10(tokens + distinct + 1))).alias("base_score"),
        "score",
    )


def op7_lm(spark, sf_dir):
    """Scores of all documents under the attention model and the word unigram."""
    return score(table(spark, sf_dir, "documents"))
