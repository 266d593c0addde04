"""Order MinHash fingerprints, in DataFrame operations only.

A text is a row of tokens whose cuts depend on what stands there, never on where it stands, so that an
inserted character changes the tokens around it and no others. In scripts that are written without spaces
(and from U+2000 on) a token begins at every character and takes in the two behind it; elsewhere a token
ends at white space or behind a character of ``CUTS``, an even spread of letters and digits, and all marks. Where
``LONGEST`` characters follow without any of these, as in alphabets that have none of CUTS, a token begins at every
character too, until fewer are left.
Its k-mers, ``K`` tokens in a row at every token, are numbered by occurrence, so that a k-mer's second and third occurrences are
other elements than its first. A hash of (k-mer, occurrence) deals the elements to ``sketches`` sketches
and orders them; each sketch takes its ``tuple_size`` smallest, puts them back in text order, and hashes
the k-mers in that order. Two fingerprints agree in a sketch if the same k-mers stand there in the same
order, which makes the likeness sensitive to edit distance and not to content alone.

All of it works on sorted arrays of packed 64-bit numbers within the row. Occurrences are numbered by
doubling: runs of equal hashes are contiguous once sorted, and as many rounds are taken as the longest
run's length doubles.

Defined results: equal texts have equal fingerprints; texts that differ in white space alone do too. A
text without tokens has an empty fingerprint, whose likeness is 1 to another empty one and 0 to any
other. Texts of over 2 ** 26 tokens have positions that wrap. Extra columns are left out. Documents with equal ids follow each other by text; null ids come last.
Rows of one id stand in one bucket, however many: ids are taken to name documents.

K-mers at every character were tried with these functions: only their hashing took 670 ns a character, or
2300 CPU seconds a GB of input for the two texts of a row, as functions on arrays are interpreted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Code points of scripts without spaces, and where other runs of characters are cut.
UNSPACED = r"\u0E00-\u109F\u1780-\u17FF\u2000-\x{10FFFF}"
CUTS = r"fkpwxzFKPWXZ06\x{C6}\x{CC}\x{D2}\x{D8}\x{DE}\x{E4}\x{EA}\x{F0}\x{F6}\x{FC}!-/:-@\[-`{-~"
LONGEST = 24
K = 4
POSITION_BITS = 26
LOW = (1 << POSITION_BITS) - 1


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _top(x: Column) -> Column:
    return F.shiftright(x, POSITION_BITS)


def tokens_of(text: Column) -> Column:
    """Tokens in text order. Only texts that need it take the pattern that looks ahead at every character."""
    letter = rf"[^\s{CUTS}{UNSPACED}]"
    run = rf"{letter}{{1,{LONGEST - 1}}}[{CUTS}]?|[{CUTS}]"
    more = lambda n: f"{letter}(?={letter}{{{n}}})"
    overlapping = rf"(?=([{UNSPACED}]{{1,3}}|{letter}{{2}}{more(LONGEST - 3)}|{run}))(?:[{UNSPACED}]|{more(LONGEST - 1)}|{run})"
    plain = F.regexp_extract_all(text, F.lit(run), F.lit(0))
    return F.when(text.rlike(f"[{UNSPACED}]|{letter}{{{LONGEST}}}"), F.regexp_extract_all(text, F.lit(overlapping), F.lit(1))).otherwise(plain)


def _packed_kmers(text: Column) -> Column:
    """Each k-mer in text order: 38 bits of its hash over its position. A text with fewer tokens is one k-mer."""
    tokens = tokens_of(F.coalesce(text, F.lit("")))

    def kmers(t: Column) -> Column:
        last = F.greatest(F.size(t) - K + 1, F.least(F.size(t), F.lit(1)))

        def one(x: Column, i: Column) -> Column:
            h = F.xxhash64(x, *[F.coalesce(F.get(t, i + j), F.lit("")) for j in range(1, K)])
            return h.bitwiseAND(F.lit(~LOW)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(LOW)))

        return F.transform(F.slice(t, F.lit(1), last), one)

    return _let(tokens, kmers)


def _occurrences(repeats: Column) -> Column:
    """Of the ascending places that continue a run in a sorted array, each place's occurrence number, from 1.

    Places of one run follow each other. start[j], where j's run begins, is the largest j that begins
    one; maxima over 1, 2, 4 ... steps carry it through a run, and stop when no run is that long.
    """
    first = F.transform(repeats, lambda i, j: F.when((j > 0) & (F.get(repeats, j - 1) == i - 1), F.lit(0)).otherwise(j))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(repeats) + F.lit(1.0))).cast("int"))

    def once(start: Column, step: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), step)
        long_run = F.exists(F.sequence(F.lit(0), F.size(repeats) - 1), lambda j: (j >= far) & (F.get(start, j) == 0) & (F.get(repeats, j) - F.get(repeats, j - far) == far))
        spread = F.transform(start, lambda s, j: F.greatest(s, F.coalesce(F.get(start, j - far), F.lit(0))))
        return F.when(long_run, spread).otherwise(start)

    return F.when(F.size(repeats) > 0, _let(F.aggregate(steps, first, once), lambda s: F.transform(s, lambda x, j: j - x + 1))).otherwise(repeats)


def _value(kmers: Column) -> Column:
    """32 bits of the hash of k-mers in order, never 0."""
    return F.greatest(F.lit(1).cast("long"), F.xxhash64(F.concat_ws(",", F.transform(kmers, lambda h: h.cast("string")))).bitwiseAND(F.lit(0xFFFFFFFF)))


def signature(text: Column, sketches: int = 64, tuple_size: int = 2) -> Column:
    """Array of one 32-bit value a sketch; 0 where a sketch is empty.

    Sorting whole arrays of numbers is the cheap step here (sort_array, not array_sort, which calls a
    comparator for every pair), so sketches are found as runs of one sorted array.
    """
    bits = sketches.bit_length() - 1
    if 1 << bits != sketches:
        raise ValueError("sketches has to be a power of two")
    at = lambda x: x.bitwiseAND(F.lit(LOW))
    sketch = lambda x: F.shiftrightunsigned(x, 64 - bits)
    key = lambda x, n: F.xxhash64(_top(x), n).bitwiseAND(F.lit(~LOW)).bitwiseOR(at(x))

    def ordered(p: Column) -> Column:
        """sketch | order | position, so that each sketch's smallest elements come first."""
        again = lambda x, i: (i > 0) & (_top(F.get(p, i - 1)) == _top(x))
        once = F.transform(F.filter(p, lambda x, i: ~again(x, i)), lambda x: key(x, F.lit(0)))
        repeats = F.array_compact(F.transform(p, lambda x, i: F.when(again(x, i), i)))
        more = _let(repeats, lambda r: F.zip_with(r, _occurrences(r), lambda i, n: key(F.get(p, i), n)))
        return F.sort_array(F.concat(once, more))

    def chosen(q: Column) -> Column:
        """sketch | position of the tuple_size smallest of each sketch, in text order."""
        few = F.filter(q, lambda x, i: (i < tuple_size) | (sketch(F.get(q, i - tuple_size)) != sketch(x)))
        return F.sort_array(F.transform(few, lambda x: F.shiftleft(sketch(x), POSITION_BITS).bitwiseOR(at(x))))

    def values(packed: Column) -> Column:
        def filled(few: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(few) - 1), lambda i: (i == 0) | (_top(F.get(few, i - 1)) != _top(F.get(few, i))))

            def one(i: Column) -> Column:
                own = F.filter(F.slice(few, i + 1, F.lit(tuple_size)), lambda x: _top(x) == _top(F.get(few, i)))
                return _value(F.transform(own, lambda x: _top(F.get(packed, at(x).cast("int")))))

            def spread(pair: Column) -> Column:
                place = lambda j: F.array_position(pair["s"], j).cast("int")
                return F.transform(F.sequence(F.lit(0), F.lit(sketches - 1)), lambda j: F.coalesce(F.get(pair["v"], place(j) - 1), F.lit(0).cast("long")))

            pair = _let(starts, lambda st: F.struct(F.transform(st, lambda i: _top(F.get(few, i)).cast("int")).alias("s"), F.transform(st, one).alias("v")))
            return F.when(F.size(few) == 0, F.array_repeat(F.lit(0).cast("long"), sketches)).otherwise(_let(pair, spread))

        return _let(_let(_let(F.sort_array(packed), ordered), chosen), filled)

    return _let(_packed_kmers(text), values)


def likeness(a: Column, b: Column) -> Column:
    """The share of sketches that agree, of those that aren't empty in both."""
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: ((x == y) & (x != 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    used = F.aggregate(F.zip_with(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(used == 0, F.lit(1.0)).otherwise(agree / used)


def as_text(sig: Column) -> Column:
    return F.concat_ws("", F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))


def bounds_from(known: list, value: Column, fan: int = 256) -> Column:
    """How many of the descending bounds are at least value: by blocks of bounds, then within the block."""
    blocks = [known[i : i + fan] for i in range(0, len(known), fan)]
    at_least = lambda xs: F.size(F.filter(xs, lambda b: b >= value))
    if len(blocks) == 1:
        return at_least(F.array(*map(F.lit, known)))
    block = F.least(at_least(F.array(*[F.lit(b[-1]) for b in blocks])), F.lit(len(blocks) - 1))
    return _let(block, lambda k: k * fan + at_least(F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), k)))


def with_next(docs: DataFrame, id_col: str, carried: list[str], rows_per_bucket: int = 8192, max_buckets: int = 65536) -> DataFrame:
    """docs with ``next_`` columns from the following document, in descending order of id; the last's is the first.

    Bounds that are ids of the table cut the order into buckets. The document at a bound, the first of
    its bucket, is also sent to the bucket before it as a guest, so each bucket knows all its
    successors, and the rows are shuffled once. Buckets hold about ``rows_per_bucket`` rows as long as
    ``max_buckets`` suffice (500 million rows), and grow beyond; their windows spill to disk.
    """
    ids = docs.select(F.col(id_col).alias("id"))
    n = ids.count()
    buckets = min(max_buckets, max(1, -(-n // rows_per_bucket)))
    shares = [i / buckets for i in range(1, buckets + 1)]
    facts = ids.agg(F.percentile_approx("id", shares, 100_000).alias("bounds"), F.max("id").alias("top")).first()
    bounds = sorted({*(facts["bounds"] or []), *([facts["top"]] if facts["top"] is not None else [])}, reverse=True)
    last = max(0, len(bounds) - 1)
    if bounds:
        own = F.when(F.col(id_col).isNull(), F.lit(last)).otherwise(bounds_from(bounds, F.col(id_col)) - 1)
        at_bound = F.col(id_col).isin(bounds)
    else:
        own, at_bound = F.lit(0), F.lit(False)
    guest_of = F.when(F.coalesce(at_bound, F.lit(False)), (F.col("_own") + last) % F.lit(last + 1))
    x = docs.withColumn("_own", own)
    if not bounds:  # ids are all null: the first row by text follows the last
        guest_of = F.lit(0)
    places = F.array(F.struct(F.col("_own").alias("bucket"), F.lit(0).alias("guest")), F.struct(guest_of.alias("bucket"), F.lit(1).alias("guest")))
    x = x.withColumn("_place", F.explode(F.filter(places, lambda p: p["bucket"].isNotNull()))).drop("_own")
    x = x.withColumn("_bucket", F.col("_place.bucket")).withColumn("_guest", F.col("_place.guest")).drop("_place")
    x = x.repartition(2 * (last + 1), "_bucket")  # by number: the work is in the texts' signatures, not in their bytes
    order = Window.partitionBy("_bucket").orderBy("_guest", F.col(id_col).desc_nulls_last(), "text")
    for c in carried:
        x = x.withColumn(f"next_{c}", F.lead(c).over(order))
    return x.filter("_guest = 0").drop("_bucket", "_guest")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketches: int = 64, tuple_size: int = 2) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next text's.

    The edited text has the last third of its characters replaced by as many of the next document's first.
    """
    sign = lambda c: signature(c, sketches, tuple_size)
    x = docs.select(docs[id_col], F.coalesce(docs[text_col], F.lit("")).alias("text"))
    x = x.withColumn("n_chars", F.length("text").cast("long")).withColumn("sig", sign(F.col("text")))
    x = with_next(x, id_col, ["text", "sig"])
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substr("next_text", F.lit(1), cut))
    x = x.withColumn("edited", edited).withColumn("edited_sig", sign(F.col("edited")))
    return x.select(
        id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
