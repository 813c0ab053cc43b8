"""Near-duplicate lines across and within documents by an exact set-similarity join, with DataFrame operations only.

A line's tokens are its word shingles; the set of them is its value. Two sets at the threshold share tokens in their
prefixes, the first few tokens of each in any total order. Lines with equal sets are joined first; then two filters
follow, each over all that the one before it left:

1. The order is that of the hash, but tokens that begin with one of FIRST come before all others. A prefix is two
   tokens longer than needed, so that two sets at the threshold share at least three of its tokens; a set stays if
   three of its prefix tokens are also in the prefix of a set of like size. This only counts, so that no pair is formed
   and no token is too frequent for it. Where the tokens that come first fill the prefix of a line, as they do in most
   lines of 40 words or more, no others are made, and the set's size is only known to lie between two bounds.
2. The order is that of rarity: tokens are counted over all sets that are left, exactly. A token that one set alone
   holds comes first and joins nothing, so that a set stays only if its share of other tokens reaches the threshold.
   Prefixes of this order are joined by length, position, and a parity bitmap that bounds the symmetric difference.

Pairs that remain are verified on the sets. Large groups of near copies are never expanded: each set is compared with
one that is the earliest on its prefix tokens, and only those that this leaves open meet all the others.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, computed_once, discard, join_small, materialize, one_row_per_id, text_or_empty

#: Prefix tokens that two sets at the threshold share at least in the first filter.
SHARED = 3
#: Bits of a line number in the number of a set.
LINE_BITS = 22
#: Tokens for each shuffle partition up to which tokens are joined by hash, whose tables of distinct tokens cannot spill; more are sorted.
HASHED_TOKENS = 4_000_000


#: First characters of a word that bring its token forward in the first filter: about two fifths of all words, and all of other scripts than Latin.
FIRST = "bdfhjlnprtvxz02468" + "".join(chr(c) for c in range(0xC0, 0x100, 2))
#: A character beyond the 256 for which a regular expression has a bitmap; without one, classes of listed characters are several times as fast.
_WIDE = r"[\x{100}-\x{10ffff}]"


def _listed(test: Callable[[str], bool]) -> str:
    return "".join(f"\\x{c:02x}" for c in range(256) if test(chr(c)))


def _plain(lines: DataFrame, n: int, *columns: str) -> DataFrame:
    """(*columns, plain, words, wide) of the rows of lines(*columns, content) with n words or more: the lower-cased words with a blank between, their number, whether any character is _WIDE."""
    # to find each word by a regular expression costs more than all else: these find punctuation only
    gap = _listed(lambda c: not (c.isalnum() or c == "_"))
    narrow, general = f"[{gap.replace(r'\x20', '')}][{gap}]*", r"[^ \p{L}\p{N}_][^\p{L}\p{N}_]*"
    lower = lines.select(*columns, F.lower("content").alias("low"))
    lower = lower.withColumn("wide", (F.octet_length("low") != F.length("low")) & F.col("low").rlike(_WIDE))
    spaced = F.when(F.col("wide"), F.regexp_replace("low", general, " ")).otherwise(F.regexp_replace("low", narrow, " "))
    spaced = lower.select(*columns, "wide", spaced.alias("spaced"))
    once = F.when(F.contains("spaced", F.lit("  ")), F.regexp_replace("spaced", " +", " ")).otherwise(F.col("spaced"))
    plain = spaced.select(*columns, "wide", F.trim(once).alias("plain"))
    words = F.when(F.col("plain") == "", 0).otherwise(F.size(F.split("plain", " ")))
    return computed_once(plain.select(*columns, "wide", "plain", words.alias("words")), F.col("words") >= n)


def _tokens_at(n: int, forward: bool) -> Column:
    """Hashes of the distinct shingles in plain whose first character is in FIRST, or of all others: sorted."""
    first = _listed(lambda c: c != " " and (c in FIRST) == forward)
    shingle = lambda first, other: F.lit(f" (?=({first}{other}*{f' {other}+' * (n - 1)}))")
    found = lambda pattern: F.regexp_extract_all(F.concat(F.lit(" "), "plain"), pattern, 1)
    narrow = shingle(f"[{first}]", f"[{_listed(lambda c: c != ' ')}]")
    general = shingle(f"[{first}{_WIDE}]" if forward else f"[{first}]", "[^ ]")
    hashes = F.transform(F.when(F.col("wide"), found(general)).otherwise(found(narrow)), lambda x: F.xxhash64(x))
    return F.sort_array(F.array_distinct(hashes))


def _with_prefix(lines: DataFrame, n: int, t: Fraction, *columns: str) -> DataFrame:
    """(*columns, key, check, least, most, prefix) of the rows of lines(*columns, content) with n words or more.

    The set has least to most tokens; prefix: its first tokens in the order of the first filter. Lines of the same words
    have the same key and check; so have all lines of a set that none but an equal one can match.
    """
    m = F.col("words") - (n - 1)
    length = m - _least_common(m, t) + F.least(F.lit(SHARED), _least_common(m, t))  # enough, as the set has m tokens at most
    lined = _plain(lines, n, *columns).withColumn("own", _tokens_at(n, True)).withColumn("length", length)
    lined = lined.withColumn("full", (F.size("own") >= F.col("length")) & ~_alone(F.size("own"), t))
    rest = F.when(F.col("full"), F.array().cast("array<bigint>")).otherwise(_tokens_at(n, False))
    lined = lined.withColumn("tokens", F.concat("own", rest))
    either = lambda f: F.when(F.col("full"), f("plain")).otherwise(f("tokens"))
    prefix = F.transform(F.slice("tokens", F.lit(1), F.col("length")), lambda x: F.shiftrightunsigned(x, 16))  # 48 bits, as it only filters
    most = F.when(F.col("full"), m).otherwise(F.size("tokens"))
    return lined.select(*columns, either(F.xxhash64).alias("key"), either(F.hash).alias("check"), F.size("tokens").alias("least"), most.alias("most"), prefix.alias("prefix"))


def _with_tokens(lines: DataFrame, n: int, *columns: str) -> DataFrame:
    """(*columns, tokens) of the rows of lines(*columns, content) with n words or more: sorted hashes of the distinct shingles."""
    hashed = _plain(lines, n, *columns).select(*columns, F.transform(F.split("plain", " "), lambda x: F.xxhash64(x)).alias("h"))
    shingles = F.transform(F.slice("h", F.lit(1), F.size("h") - (n - 1)), lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, n)]))
    return hashed.select(*columns, F.sort_array(F.array_distinct(shingles)).alias("tokens"))


def _split(docs: DataFrame) -> DataFrame:
    return docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "content"))


def _least_common(n: Column, t: Fraction) -> Column:
    """Tokens that a set of n has in common with any set at the threshold t, at least."""
    return F.ceil(n * t.numerator / t.denominator).cast("int")


def _alone(n: Column, t: Fraction) -> Column:
    """Whether a set of n tokens has no set at the threshold t but an equal one."""
    return n * t.denominator < (n + 1) * t.numerator


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, removed): of every document that loses lines, the sorted numbers (from 0) of those lines.

    A line goes if an earlier line, in the order of id and line number, has a Jaccard similarity of threshold or
    more, whether that line stays or not; so of equal lines the first stays. Lines are split at "\n"; words are
    lower-cased runs of letters, digits and "_"; a line of fewer than n words has no shingle and always stays. Null
    and empty texts lose nothing; texts and lines of any length are taken whole. Rows with a null id lose nothing.
    Rows that repeat an id count as one, with the smallest of their texts. Other columns are not looked at. An empty
    table gives no rows.
    """
    t = Fraction(threshold).limit_denominator(1000)
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    source = one_row_per_id(source, "doc", "text")
    digests = _with_prefix(_split(source), n, t, "doc", "line")
    digests = _numbered(materialize(digests, "lines"))

    same = ["key", "check"]
    # a table of its own, so that adaptive execution can split a set of very many copies in the join
    firsts = materialize(digests.groupBy(*same).agg(F.min("gid").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "firsts")
    again = digests.select("gid", "doc", "line", *same).join(firsts, same).where(F.col("gid") != F.col("first"))
    again = materialize(again.select("gid", "doc", "line"), "again")
    # a set that none of this size can match but an equal one is left out
    sets = join_small(digests.where(~_alone(F.col("least"), t)).select("gid", "doc", "line", "least", "most", "prefix"), again.select("gid"), "gid", "left_anti")
    total = digests.agg(F.sum("most")).first()[0] or 0
    likely = materialize(_likely(sets, t, total), "likely")
    matched = likely.join(_matched(source, likely, n, t, total), "gid", "left_semi")
    gone = again.select("doc", "line").union(matched.select("doc", "line"))
    return gone.groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("removed")).withColumnRenamed("doc", id_col)


def _numbered(digests: DataFrame) -> DataFrame:
    """digests with gid, a long that follows the order of (doc, line): both packed into one where they fit, else numbers in sorted order."""
    least, most, line = digests.agg(F.min("doc"), F.max("doc"), F.max("line")).first()
    if least is None or 0 <= least and most < 1 << 62 - LINE_BITS and line < 1 << LINE_BITS:
        return digests.withColumn("gid", F.shiftleft("doc", LINE_BITS).bitwiseOR(F.col("line").cast("long")))
    ordered = digests.repartitionByRange("doc", "line").sortWithinPartitions("doc", "line")
    return materialize(ordered.withColumn("gid", F.monotonically_increasing_id()), "numbered")


def _hashed(tokens: DataFrame, total: int) -> DataFrame:
    """tokens as the hashed side of a join, where total tokens, repeats too, leave it small in each partition."""
    partitions = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tokens.hint("shuffle_hash") if total <= HASHED_TOKENS * partitions else tokens


def _likely(sets: DataFrame, t: Fraction, total: int) -> DataFrame:
    """(doc, line, gid) of those of sets(gid, doc, line, least, most, prefix) that the first filter leaves; total: tokens of all sets, at most."""
    held = sets.select("least", "most", F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("m"), F.max("least").alias("least"), F.min("most").alias("most"))
    like = F.col("most") * t.denominator >= F.col("least") * t.numerator  # whether two sets can be; of more, some are taken to be alike
    held = held.where((F.col("m") > 2) | ((F.col("m") == 2) & like)).select("token")
    hits = sets.select("gid", F.explode("prefix").alias("token")).join(_hashed(held, total), "token", "left_semi").groupBy("gid").agg(F.count("*").alias("hits"))
    enough = F.col("hits") >= F.least(F.lit(SHARED), _least_common(F.col("least"), t))
    return sets.select("gid", "doc", "line", "least").join(hits, "gid").where(enough).select("doc", "line", "gid")


def _candidate(a: str, b: str, t: Fraction) -> Column:
    """Whether the length, positional and bitmap filters pass a pair of postings; b is the earlier line."""
    p, q = t.numerator, t.denominator
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    length = (na * q >= nb * p) & (nb * q >= na * p)
    room = 1 + F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))  # positions count from 1
    position = room * (p + q) >= (na + nb) * p
    apart = F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits")))
    bitmap = apart * (p + q) <= (na + nb) * (q - p)  # |A xor B| <= (|A| + |B|) (1 - t) / (1 + t)
    return (F.col(f"{b}.gid") < F.col(f"{a}.gid")) & length & position & bitmap


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """(gid) of the a in pairs(a, b) whose sets have a Jaccard similarity of t or more; sets(gid, n, ranked) lack tokens that one set alone holds."""
    p, q = t.numerator, t.denominator
    side = lambda gid, size, tokens: sets.select(F.col("gid").alias(gid), F.col("n").alias(size), F.col("ranked.token").alias(tokens))
    both = pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * (p + q) >= (F.col("na") + F.col("nb")) * p).select(F.col("a").alias("gid")).distinct()


def _ranked(tokens: DataFrame, t: Fraction, total: int) -> DataFrame:
    """(gid, n, bits, ranked) of the sets in tokens(gid, tokens) with enough tokens that others hold too; ranked: these as (df, token), rarest first."""
    parity = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(x, 58).cast("int"))))
    held = tokens.select("gid", F.explode("tokens").alias("token"))
    counts = held.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = held.join(_hashed(counts, total), "token").groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    sized = tokens.select("gid", F.size("tokens").alias("n"), parity.alias("bits"))
    return sized.join(ranked, "gid").where(F.size("ranked") >= _least_common(F.col("n"), t))


def _matched(source: DataFrame, likely: DataFrame, n: int, t: Fraction, total: int) -> DataFrame:
    """(gid) of the sets in likely(doc, line, gid) with an earlier set at the threshold t."""
    tokens = materialize(_with_tokens(join_small(_split(source), likely, ["doc", "line"], "inner"), n, "gid"), "tokens")
    sets = materialize(_ranked(tokens, t, total), "ranked")
    discard(tokens)

    alone = F.col("n") - F.size("ranked")  # tokens that come first, as no other set holds them
    prefix = F.slice("ranked", F.lit(1), F.col("n") - _least_common(F.col("n"), t) + 1 - alone)
    own = sets.select("gid", "n", "bits", alone.alias("alone"), F.posexplode(prefix).alias("place", "r"))
    own = materialize(own.select(F.col("r.token").alias("token"), "gid", "n", "bits", (F.col("alone") + F.col("place") + 1).alias("pos")), "postings")

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        on = (F.col("a.token") == F.col("b.token")) & _candidate("a", "b", t)
        return left.alias("a").join(right.alias("b"), on).select(F.col("a.gid").alias("a"), F.col("b.gid").alias("b"))

    first = materialize(own.groupBy("token").agg(F.min(F.struct("gid", "n", "bits", "pos")).alias("f")).select("token", "f.*"), "first")
    one = near(own, first).groupBy("a").agg(F.min("b").alias("b"))
    at_first = materialize(_verified(one, sets, t), "matched")
    still = join_small(own, at_first, "gid", "left_anti")
    rest = _verified(near(still, own).distinct(), sets, t)
    return materialize(at_first.union(rest), "all-matched")


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose texts lack the lines in removed(id, removed); all rows and columns stay."""
    removed = materialize(removed.select(F.col(id_col), F.col("removed").alias("__removed")), "removed")
    few = removed.agg(F.coalesce(F.sum(F.size("__removed") + 4), F.lit(0))).first()[0] <= 4 * BROADCAST_ROWS
    joined = docs.join(F.broadcast(removed) if few else removed, id_col, "left")
    # a lambda binds the lines, so that the text is split once
    numbers = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__removed")
    kept = F.transform(F.array(F.split(text_col, "\n")), lambda lines: F.array_join(F.transform(numbers(lines), lambda i: F.get(lines, i)), "\n"))
    return joined.withColumn(text_col, F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(kept[0])).select(*docs.columns)


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_lines, n_removed, removed) of every row of docs; removed holds the numbers of the lines that go."""
    removed = materialize(removed_lines(docs, id_col, text_col, **options), "removed")
    lines = docs.select(id_col, F.size(F.split(text_or_empty(text_col), "\n")).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    joined = lines.join(removed, id_col, "left").withColumn("removed", F.coalesce("removed", none))
    return joined.select(id_col, "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")
