"""Close terms of a few thousand query terms, found in Python workers.

The signatures are those of ``edits``: deletions of short terms, halves of medium ones.  Terms meet by
the hashes of their signatures, which no rows are made of, and the edits of each pair that meets are
counted on arrays.  Equal signatures have equal hashes, and pairs that meet by chance are counted too,
so the result does not depend on the hashes.
"""

from .edits import HALVED_TERM, SHORT_TERM

BITS = 22  # of the table that most hashes are looked up in before the sorted ones are searched


def _hasher():
    """Functions ``(same length terms as code points) -> hashes`` with all ways of leaving out up to some letters."""
    def tools():
        import numpy as np

        base = 0x9E3779B97F4A7C15 | 1
        inverse = pow(base, -1, 1 << 64)
        return np, base, np.uint64(inverse), np.uint64(inverse * inverse % (1 << 64))

    def points(terms):
        """Code points of terms of one length, one row for each."""
        np, *_ = tools()
        return np.frombuffer("".join(terms).encode("utf-32-le"), dtype="<u4").reshape(len(terms), -1).astype(np.uint64)

    def left_out(letters, depth):
        """Hashes of the terms without up to ``depth`` letters, one array for each choice of letters."""
        np, base, once, twice = tools()
        length = letters.shape[1]
        powers = np.array([pow(base, k + 1, 1 << 64) for k in range(length)], dtype=np.uint64)
        upto = np.zeros((length + 1, len(letters)), dtype=np.uint64)
        np.cumsum((letters * powers).T, axis=0, out=upto[1:])
        yield upto[length]
        for i in range(length if depth else 0):
            yield upto[i] + (upto[length] - upto[i + 1]) * once
        for i in range(length if depth > 1 else 0):
            for j in range(i + 1, length):
                yield upto[i] + (upto[j] - upto[i + 1]) * once + (upto[length] - upto[j + 1]) * twice

    def salted(length, side):
        np, base, *_ = tools()
        return np.uint64(pow(base, 1000 + 2 * length + side, 1 << 64))

    return points, left_out, salted


def _asked_hashes(terms: list, short: int, halved: int):
    """Hashes of all signatures of query terms ``[(term, allowed edits)]``, sorted, and the number of the term of each."""
    import numpy as np

    points, left_out, salted = _hasher()
    by_kind = {}
    for number, (term, edits) in enumerate(terms):
        by_kind.setdefault((len(term), edits), []).append(number)
    found, whose = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]

    def add(hashes, numbers):
        found.append(hashes)
        whose.append(numbers)

    for (n, edits), numbers in by_kind.items():
        letters, numbers = points([terms[k][0] for k in numbers]), np.array(numbers)
        if 3 <= n <= short + 2:
            for h in left_out(letters, edits):
                add(h, numbers)
        if short - 1 <= n <= halved + 2:
            for length in range(max(n - 2, short + 1), min(n + 2, halved) + 1):
                for side, half in ((0, length // 2), (1, length - length // 2)):
                    for size in (half - 1, half, half + 1):
                        part = letters[:, :size] if side == 0 else letters[:, max(0, n - size):]
                        for h in left_out(part, 1):
                            add(h + salted(length, side), numbers)
    found, whose = np.concatenate(found), np.concatenate(whose)
    order = np.lexsort((whose, found))
    found, whose = found[order], whose[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (whose[1:] != whose[:-1])
    return found[new], whose[new]


def _edit_counter():
    """Function ``(letters, letters) -> edits``, 3 for more than two, of pairs of terms; a swap of neighbours is one edit."""
    def edits(left, right):
        import numpy as np

        n, m, far = left.shape[1], right.shape[1], np.full(len(left), 9, dtype=np.int8)
        before, last = {}, {j: np.full(len(left), j, dtype=np.int8) for j in range(min(m, 2) + 1)}
        for i in range(1, n + 1):
            row = {}
            for j in range(max(0, i - 2), min(m, i + 2) + 1):  # others are more than two edits away
                if j == 0:
                    row[j] = np.full(len(left), i, dtype=np.int8)
                    continue
                least = np.minimum(last.get(j, far), row.get(j - 1, far)) + np.int8(1)
                np.minimum(least, last.get(j - 1, far) + (left[:, i - 1] != right[:, j - 1]), out=least)
                if i > 1 and j > 1 and j - 2 in before:
                    swap = (left[:, i - 1] == right[:, j - 2]) & (left[:, i - 2] == right[:, j - 1])
                    np.minimum(least, np.where(swap, before[j - 2] + np.int8(1), far), out=least)
                row[j] = least
            before, last = last, row
        return np.minimum(last.get(m, far), 3)

    return edits


def close_terms(terms: list):
    """Function for ``mapInArrow`` over distinct terms: ``query_term, term, edits`` within the allowed edits.

    ``terms`` are the query terms with their allowed edits.  They travel to the tasks with a few
    hundred hashes each.  Terms of the vocabulary beyond HALVED_TERM letters are not looked at.
    """
    import numpy as np

    short, halved, bits = SHORT_TERM, HALVED_TERM, BITS
    hashes, whose = _asked_hashes(terms, short, halved)
    asked, allowed = [t for t, _ in terms], np.array([e for _, e in terms], dtype=np.int64)
    hasher, edits = _hasher(), _edit_counter()

    def pairs_of(variants, table, shift, mixed):
        """Rows of the terms and numbers of the query terms that share a hash, each pair once."""
        import numpy as np

        found = [np.zeros(0, dtype=np.int64)]
        for h in variants:
            rows = np.flatnonzero(table[((h * mixed) >> shift).astype(np.int64)])
            h = h[rows]
            first = np.searchsorted(hashes, h)
            sizes = np.searchsorted(hashes, h, side="right") - first
            at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            found.append(np.repeat(rows, sizes) * len(asked) + whose[at])
        return np.divmod(np.unique(np.concatenate(found)), len(asked))

    def close(batches):
        import numpy as np
        import pyarrow as pa

        points, left_out, salted = hasher
        shift, mixed = np.uint64(64 - bits), np.uint64(0xD6E8FEB86659FD93)
        table = np.zeros(1 << bits, dtype=bool)
        table[((hashes * mixed) >> shift).astype(np.int64)] = True
        asked_lengths = np.array([len(t) for t in asked], dtype=np.int64)
        texts_asked = np.array(asked, dtype=object)

        for batch in batches:
            texts = np.array(batch.column("term").drop_null().to_pylist(), dtype=object)
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            for n in np.unique(lengths[(lengths >= 2) & (lengths <= halved)]):
                some = texts[lengths == n]
                letters = points(some)
                if n <= short:
                    variants = left_out(letters, 2)
                else:
                    half = n // 2
                    variants = (
                        h + salted(int(n), side) for side, part in ((0, letters[:, :half]), (1, letters[:, half:])) for h in left_out(part, 1)
                    )
                row, query = pairs_of(variants, table, shift, mixed)
                for m in np.unique(asked_lengths[query]):
                    if abs(m - n) > 2:
                        continue
                    own = asked_lengths[query] == m
                    of_row, of_query = row[own], query[own]
                    used, place = np.unique(of_query, return_inverse=True)
                    count = edits(points(texts_asked[used])[place], letters[of_row])
                    kept = count <= allowed[of_query]
                    if kept.any():
                        yield pa.RecordBatch.from_pydict({
                            "query_term": pa.array(texts_asked[of_query[kept]], pa.string()), "term": pa.array(some[of_row[kept]], pa.string()),
                            "edits": pa.array(count[kept].astype(np.int32)),
                        })

    return close
