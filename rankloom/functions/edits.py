"""Edit distance with adjacent swaps and signatures that find close terms by equality."""

from pyspark.sql import Column, DataFrame, functions as F

from .text import bind

# Term lengths up to which deletions, then halves, find close terms; beyond come pieces.
SHORT_TERM = 9
HALVED_TERM = 64
PIECES = 5


def allowed_edits(term: Column) -> Column:
    """Edits granted by term length: up to 2 letters none, 3-5 one, longer two."""
    n = F.char_length(term)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def _letters(term: Column) -> Column:
    return F.split(term, "")


def sorted_letters(term: Column) -> Column:
    """The letters of a term in order; neighbours swapped around give the same string."""
    return F.array_join(F.sort_array(_letters(term)), "")


def _some_swap(left: Column, right: Column, accepts) -> Column:
    """Whether ``accepts(swapped, i)`` holds for some swap of letters i and i + 1 of ``left``."""
    n = F.char_length(left)

    def swapped(i):
        return F.concat(
            F.substring(left, F.lit(1), i - 1), F.substring(left, i + 1, F.lit(1)),
            F.substring(left, i, F.lit(1)), F.substring(left, i + 2, n),
        )

    return F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: (n > 1) & bind(swapped(i), lambda s: accepts(s, i)),
    )


def _swap_and_other_edit(left: Column, right: Column) -> Column:
    """Whether one swap plus one edit elsewhere turns ``left`` into ``right`` (plain distance 3)."""
    def accepts(swapped, i):
        # a new letter between the two swapped ones would edit them a second time
        inside = F.substring(right, i + 1, F.lit(1))
        between = (
            (F.char_length(right) > F.char_length(left))
            & (F.concat(F.left(right, i), F.substring(right, i + 2, F.char_length(right))) == swapped)
            & (inside != F.substring(left, i, F.lit(1))) & (inside != F.substring(left, i + 1, F.lit(1)))
        )
        return (F.levenshtein(swapped, right) == 1) & ~between

    return _some_swap(left, right, accepts)


def _two_swaps(left: Column, right: Column) -> Column:
    """Whether two swaps of separate neighbours turn ``left`` into ``right``."""
    def crossed(at):
        return F.substring(left, at, F.lit(2)) == F.reverse(F.substring(right, at, F.lit(2)))

    differing = F.filter(
        F.sequence(F.lit(1), F.char_length(left)),
        lambda k: F.substring(left, k, F.lit(1)) != F.substring(right, k, F.lit(1)),
    )
    return bind(
        differing,
        lambda at: F.coalesce(
            (F.size(at) == 4) & crossed(F.get(at, F.lit(0))) & crossed(F.get(at, F.lit(2)))
            & (F.get(at, F.lit(1)) == F.get(at, F.lit(0)) + 1) & (F.get(at, F.lit(3)) == F.get(at, F.lit(2)) + 1),
            F.lit(False),
        ),
    )


def swap_distance(left: Column, right: Column, left_sorted: Column = None, right_sorted: Column = None) -> Column:
    """Edit distance in which swapping two neighbours is one edit.

    A swap costs two plain edits, so distance 2 or less needs a plain distance of at most
    4 and results above 2 are plain distances.  Plain 2 may be one swap, plain 3 a swap
    with one edit, plain 3 or 4 two swaps.  Sorted letters may be passed in when they are
    already known.
    """
    left_sorted = sorted_letters(left) if left_sorted is None else left_sorted
    right_sorted = sorted_letters(right) if right_sorted is None else right_sorted
    same_letters = (F.char_length(left) == F.char_length(right)) & (left_sorted == right_sorted)

    def resolve(plain):
        one_swap = (plain == 2) & same_letters & _some_swap(left, right, lambda s, _: s == right)
        # one edit besides a swap changes at most two of the sorted letters
        with_edit = (
            (plain == 3) & (F.levenshtein(left_sorted, right_sorted) <= 2) & _swap_and_other_edit(left, right)
        )
        two_swaps = plain.isin(3, 4) & same_letters & _two_swaps(left, right)
        return F.when(one_swap, 1).when(with_edit | two_swaps, 2).otherwise(plain)

    return bind(F.levenshtein(left, right), resolve)


def with_deletions(df: DataFrame, term: str) -> DataFrame:
    """One row per way of removing none, one or two letters of ``term``.

    Adds ``sig``, what is left, and ``depth``, the number of letters removed.
    """
    n, i, j = F.char_length(term), F.col("_i"), F.col("_j")
    word = F.col(term)
    one = F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n))
    two = F.concat(
        F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, j - i - 1), F.substring(word, j + 1, n)
    )
    return (
        df.withColumn("_i", F.explode(F.sequence(F.lit(0), n)))
        .withColumn("_j", F.explode(F.sequence(i, F.when(i == 0, 0).otherwise(n))))
        .withColumns({
            "depth": F.when(i == 0, 0).when(i == j, 1).otherwise(2),
            "sig": F.when(i == 0, word).when(i == j, one).otherwise(two),
        })
        .drop("_i", "_j")
    )


def _with_one_deletion(df: DataFrame, part: str) -> DataFrame:
    """One row for ``part`` itself and for each single letter removed from it, as ``_rest``."""
    word, i = F.col(part), F.col("_i")
    one = F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word)))
    return (
        df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.char_length(word))))
        .withColumn("_rest", F.when(i == 0, word).otherwise(one))
        .drop("_i", part)
    )


def with_halves(df: DataFrame, term: str, own: bool) -> DataFrame:
    """Add ``sig`` rows from both halves of a term, each with up to one letter removed.

    Two edits leave one half of a term with at most one edit, wherever the cut is; a swap
    across the cut looks like one replaced letter from either side.  A vocabulary term
    (``own``) lists its own halves.  A query term lists what could face them for every
    length within two letters of its own, each part one letter shorter or longer as well.
    """
    n, length, side = F.char_length(term), F.col("_length"), F.col("_side")
    word = F.col(term)
    size = F.when(side == 0, F.floor(length / 2)).otherwise(length - F.floor(length / 2)).cast("int")
    lengths = F.array(n) if own else F.sequence(n - 2, n + 2)
    size = size if own else size + F.col("_more")
    rows = df.withColumn("_length", F.explode(lengths)).filter(length.between(SHORT_TERM + 1, HALVED_TERM))
    rows = rows.withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
    if not own:
        rows = rows.withColumn("_more", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    part = F.when(side == 0, F.substring(word, F.lit(1), size)).otherwise(F.right(word, size))
    rows = _with_one_deletion(rows.withColumn("_part", part), "_part")
    sig = F.concat_ws("\u0001", length.cast("string"), side.cast("string"), "_rest")
    return rows.withColumn("sig", sig).drop("_length", "_side", "_more", "_rest")


def piece_signatures(term: Column, own: bool) -> Column:
    """Signatures of very long terms: two edits touch at most four of five pieces.

    A vocabulary term (``own``) lists its five pieces.  A query term lists, for every
    length within two letters of its own, each piece at each possible shift.
    """
    n = F.char_length(term)

    def piece(length, p, shift):
        start = F.floor(p * length / F.lit(PIECES)).cast("int")
        end = F.floor((p + 1) * length / F.lit(PIECES)).cast("int")
        return F.concat_ws(
            "\u0001", length.cast("string"), p.cast("string"),
            F.substring(term, F.greatest(start + shift + 1, F.lit(1)), end - start),
        )

    numbers = F.sequence(F.lit(0), F.lit(PIECES - 1))
    if own:
        return F.transform(numbers, lambda p: piece(n, p, F.lit(0)))
    near = F.sequence(F.lit(-2), F.lit(2))
    return F.array_distinct(F.flatten(F.transform(
        near,
        lambda gap: F.flatten(F.transform(
            numbers, lambda p: F.transform(near, lambda shift: piece(n + gap, p, shift))
        )),
    )))
