"""Line dedup by a log-template tree, with DataFrame functions only.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, where a token with a digit
counts as a variable field. In a leaf that holds lines enough, a position's token is a constant if at least `min_docs`
documents have it there; other tokens of the line are generalised to variable fields. Lines of a leaf with the same
constants have one template. A template recurs if `min_docs` documents hold it and constants are at least `similarity`
of its tokens. Lines of recurring templates are dropped from every document but the first (the smallest doc_id) of the
template, so that a text that exists in many copies isn't lost with its copies; `keep_first=False` drops there too.

That rule (the query's, and its SQL's) counts constants by an absolute number, so in a leaf of many documents the values of
a variable field become constants and its template falls apart into whole lines. With `share`, constants are relative to
the line: of the tokens above only those count that `share` of the documents hold which hold its `similarity`-th most
frequent token. A line whose template does not recur then joins a recurring one of its leaf with which it shares
`similarity` of its own tokens, place by place: the constants of a recurring template, or all tokens of a line that
`min_docs` documents hold. Every line that has such a pattern joins one. At most b mismatches leave one of b + 1 groups of
positions without one, so lines and patterns meet by the hashes of these groups. First a line meets the pattern that most
documents hold at each of its groups, at most b + 1 in all; only lines that none of these takes go on to all patterns of
their groups, and take the one that shares most tokens. So the many near copies of one line, which almost all match the
first, make no pairs with one another; in a leaf where many lines share a group with many patterns and match none, the
second step compares them all (keys that are hot there are split between tasks by Spark).

Documents are parsed once into the hashes of their lines and leaves, from which all counts and holders come; they are
read a second time for the text of distinct lines in leaves that recur, and a third time to take lines out. Counts are
combined before they are shuffled. A line, token or template in a third of all rows is no hot key of a join: keys of over
a 20,000th of the rows, at most 20,000 then, are broadcast; the others are shuffled. The hashes of leaves that recur are
broadcast if they are at most `broadcast_leaves`, which is counted first; if more, lines are shuffled to meet them. Lines are
known by 64-bit hashes: among 10^11 distinct lines about 300 pairs share one.

Defined results: lines are split at newlines, tokens at spaces, tabs and carriage returns; lines of fewer than `min_tokens` tokens (empty ones
too) are never dropped; null text stays null; texts that lose all lines become empty, the row stays; rows that repeat
with equal id and text are one document in all counts and are treated alike; null doc_ids come last in the order of
documents; an empty table stays empty; other columns pass through, under any names (but those asked for as `counts`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import checkpoint_dir, few, quoted

ID, HASH = "__lt_id", "__lt_hash"
COLD = 10_000  # rows of a key that is never hot


def tokens(line: Column) -> Column:
    spaced = F.replace(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def leaf(cut: Column, leading: int) -> Column:
    """The tree's leaf of a line's tokens, as a hash of their number and the leading ones."""
    masked = F.transform(F.slice(cut, 1, leading), lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))
    return F.xxhash64(F.size(cut), masked)


def joined(rows: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, most: int = 20_000) -> DataFrame:
    """rows joined with small on keys; `weight` of small says how many rows have its key, of `total` in all.

    Keys of over total / most rows are at most `most`, so they are broadcast; the rest meet in a shuffle without a hot key.
    """
    hot = small.where(F.col(weight) > max(COLD, total // most)).drop(weight)
    if hot.limit(1).count() == 0:
        return rows.join(small.drop(weight), keys)
    names = hot.select(*keys).distinct()
    cold = rows.join(F.broadcast(names), keys, "left_anti").join(small.drop(weight).join(F.broadcast(names), keys, "left_anti"), keys)
    return rows.join(few(hot), keys).unionByName(cold)


def line_hashes(docs: DataFrame, leading: int, min_tokens: int) -> DataFrame:
    """ID, HASH, and of each distinct line with tokens enough its hash and leaf; rows that repeat are one."""
    lines = F.transform(F.array_distinct(F.split("text", "\n")), lambda x: F.struct(x.alias("line"), tokens(x).alias("cut")))
    placed = F.transform(F.filter(lines, lambda x: F.size(x["cut"]) >= min_tokens), lambda x: F.struct(F.xxhash64(x["line"]).alias("lh"), leaf(x["cut"], leading).alias("leaf")))
    each = docs.where("text is not null").select(F.col("doc_id").alias(ID), F.xxhash64("text").alias(HASH), placed.alias("placed")).checkpoint()
    again = repeated(each)
    if again is not None:
        each = distinct_rows(each, again)
    return each.select(ID, HASH, F.explode("placed").alias("p")).select(ID, HASH, "p.lh", "p.leaf")


def repeated(rows: DataFrame) -> DataFrame | None:
    """The (ID, HASH) that several rows have, as __lt_i and __lt_h; None if no row repeats."""
    found = rows.groupBy(ID, HASH).agg(F.count("*").alias("n")).where("n > 1").select(F.col(ID).alias("__lt_i"), F.col(HASH).alias("__lt_h")).checkpoint()
    return few(found) if found.limit(1).count() else None


def distinct_rows(rows: DataFrame, again: DataFrame) -> DataFrame:
    """One row of each (ID, HASH); only those that repeat are shuffled."""
    same = F.col(ID).eqNullSafe(F.col("__lt_i")) & (F.col(HASH) == F.col("__lt_h"))
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates([ID, HASH]))


def found_lines(docs: DataFrame, min_docs: int, leading: int, similarity: float, min_tokens: int, broadcast_leaves: int, share: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lh, template) of lines whose template may recur; (template, docs, rows, first document) of those that do; and
    (ID, HASH, lh, template) of the documents' lines."""
    checkpoint_dir(docs.sparkSession)
    held = docs.select("doc_id", "text")
    each = line_hashes(held, leading, min_tokens)
    full = each.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).checkpoint()
    total = full.agg(F.sum("n")).first()[0] or 0
    leaves = full.select("leaf")
    if full.count() <= broadcast_leaves:
        leaves = F.broadcast(leaves)
    counts = each.join(leaves, "leaf", "left_semi").groupBy("lh").agg(F.count("*").alias("n"))
    exploded = held.where("text is not null").select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    placed = exploded.select("line", tokens(F.col("line")).alias("cut")).where(F.size("cut") >= min_tokens).select("line", leaf(F.col("cut"), leading).alias("leaf"))
    distinct = placed.join(leaves, "leaf", "left_semi").groupBy("leaf", "line").agg(F.count("*").alias("__rows")).select("leaf", "line", F.xxhash64("line").alias("lh"))
    distinct = distinct.join(counts, "lh").checkpoint()
    cut = distinct.select("leaf", "lh", "n", tokens(F.col("line")).alias("cut"))
    each_token = cut.select("leaf", "lh", "n", F.size("cut").alias("size"), F.posexplode("cut").alias("at", "token"))
    in_all = distinct.agg(F.sum(F.size(tokens(F.col("line"))))).first()[0] or 0
    held_at = each_token.groupBy("leaf", "at", "token").agg(F.sum("n").alias("held"), F.count("*").alias("rows")).where(F.col("held") >= min_docs).checkpoint()
    if share is None:
        fixed = joined(each_token, held_at.drop("held"), ["leaf", "at", "token"], "rows", in_all).groupBy("leaf", "lh", "size", "n").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("kept"))
        lines = fixed.where(F.size("kept") >= similarity * F.col("size")).select("lh", F.xxhash64("leaf", F.col("kept")).alias("template"), "n")
    else:
        lines = relative_lines(cut, joined(each_token, held_at, ["leaf", "at", "token"], "rows", in_all), min_docs, leading, similarity, share)
    lines = lines.checkpoint()
    matched = joined(each.select(ID, HASH, "lh"), lines, ["lh"], "n", total).select(ID, HASH, "lh", "template").checkpoint()
    order = F.struct(F.col(ID).isNull().alias("unnamed"), F.col(ID), F.col(HASH))
    holders = matched.groupBy("template", ID, HASH).agg(F.count("*").alias("rows"))
    recurring = holders.groupBy("template").agg(F.count("*").alias("docs"), F.sum("rows").alias("rows"), F.min(order).alias("first")).where(F.col("docs") >= min_docs).checkpoint()
    return lines.drop("n"), recurring, matched


def recurring_lines(docs: DataFrame, min_docs: int = 3, leading: int = 3, similarity: float = 0.7, min_tokens: int = 3, broadcast_leaves: int = 1_000_000, share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(lh, template) by hashes for lines whose template may recur, and (template, docs, first document) of those that do."""
    lines, recurring, _ = found_lines(docs, min_docs, leading, similarity, min_tokens, broadcast_leaves, share)
    return lines, recurring.drop("rows")


def group_keys(cut: Column, size: Column, leading: int, similarity: float) -> Column:
    """A hash for each group of positions behind the leading ones, of its number and tokens; null where a token is null."""
    groups = (size - F.ceil(similarity * size - 1e-9) + 1).cast("int")

    def key(g: Column) -> Column:
        first = F.when(g >= leading, g).otherwise((g + groups * F.ceil((leading - g) / groups)).cast("int"))
        places = F.when(first < size, F.sequence(first, size - 1, groups)).otherwise(F.array().cast("array<int>"))
        chosen = F.transform(places, lambda i: F.get(cut, i))
        return F.when(~F.exists(chosen, lambda t: t.isNull()), F.xxhash64(g, chosen))

    return F.transform(F.sequence(F.lit(0), groups - 1), key)


def relative_lines(cut: DataFrame, held_tokens: DataFrame, min_docs: int, leading: int, similarity: float, share: float) -> DataFrame:
    """(lh, template, n) of lines whose template may recur, by constants relative to the line; others join a similar one."""
    most = F.sort_array(F.collect_list(F.struct("held", "at", "token")), asc=False)
    fixed = held_tokens.groupBy("leaf", "lh", "size", "n").agg(most.alias("most"))
    wanted = F.ceil(similarity * F.col("size") - 1e-9).cast("int")
    fixed = fixed.where(F.size("most") >= wanted).withColumn("least", share * F.element_at("most", wanted)["held"])
    constant = F.filter("most", lambda x: x["held"] >= F.col("least"))
    kept = F.sort_array(F.transform(constant, lambda x: F.struct(x["at"].alias("at"), x["token"].alias("token"))))
    own = fixed.select("leaf", "lh", "size", "n", kept.alias("kept")).withColumn("template", F.xxhash64("leaf", "kept")).checkpoint()
    one = [F.first(c).alias(c) for c in ("leaf", "size", "kept")]
    found = own.groupBy("template").agg(F.sum("n").alias("held"), F.count("*").alias("rows"), *one).where(F.col("held") >= min_docs).checkpoint()
    known = found.select("template", "rows")
    here = joined(own.select("lh", "n", "template"), known, ["template"], "rows", own.count()).select("lh", "template", "n")
    rest = cut.join(here.select("lh"), "lh", "left_anti").join(few(found.select("leaf").distinct()), "leaf", "left_semi")
    lines = rest.select("lh", "leaf", F.explode(group_keys(F.col("cut"), F.size("cut"), leading, similarity)).alias("k")).checkpoint()
    patterns = all_patterns(found, own, cut, few(lines.select("leaf").distinct()), min_docs).checkpoint()
    keys = group_keys(F.col("pattern"), F.size("pattern"), leading, similarity)
    keyed = patterns.select("leaf", F.explode(keys).alias("k"), "held", "pattern_id").where("k is not null")
    heads = keyed.groupBy("leaf", "k").agg(F.max(F.struct("held", "pattern_id"))["pattern_id"].alias("pattern_id"), F.count("*").alias("patterns"))
    weighed = heads.join(lines.groupBy("leaf", "k").agg(F.count("*").alias("rows")), ["leaf", "k"]).checkpoint()
    pairs = joined(lines, weighed.drop("patterns"), ["leaf", "k"], "rows", lines.count()).select("lh", "pattern_id").distinct().checkpoint()
    asked = patterns.join(pairs.groupBy("pattern_id").agg(F.count("*").alias("rows")), "pattern_id").select("pattern_id", "template", "pattern", "rows").checkpoint()
    met = joined(pairs.join(cut.select("lh", "n", "cut"), "lh"), asked, ["pattern_id"], "rows", pairs.count())
    first = most_alike(met, similarity).checkpoint()
    more = few(weighed.where("patterns > 1").select("leaf", "k"))
    left = lines.join(first.select("lh"), "lh", "left_anti").join(more, ["leaf", "k"], "left_semi").join(cut.select("lh", "n", "cut"), "lh")
    others = keyed.join(more, ["leaf", "k"], "left_semi").join(patterns.select("pattern_id", "template", "pattern"), "pattern_id")
    second = most_alike(left.join(others.select("leaf", "k", "template", "pattern"), ["leaf", "k"]), similarity)
    return here.unionByName(first).unionByName(second)


def all_patterns(found: DataFrame, own: DataFrame, cut: DataFrame, leaves: DataFrame, min_docs: int) -> DataFrame:
    """pattern_id, leaf, template, held, pattern (null at variable fields) of the leaves: recurring templates, and lines with
    variable fields that recur as they stand."""
    constants = F.map_from_entries("kept")
    pattern = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.element_at(constants, i))
    general = found.join(leaves, "leaf", "left_semi").select(F.col("template").alias("pattern_id"), "leaf", "template", "held", pattern.alias("pattern"))
    varied = own.where((F.col("n") >= min_docs) & (F.size("kept") < F.col("size"))).join(leaves, "leaf", "left_semi")
    whole = varied.select("lh", "leaf", "template", F.col("n").alias("held")).join(cut.select("lh", F.col("cut").alias("pattern")), "lh")
    return general.unionByName(whole.select(F.xxhash64("template", "lh").alias("pattern_id"), "leaf", "template", "held", "pattern"))


def most_alike(met: DataFrame, similarity: float) -> DataFrame:
    """(lh, template, n) of lines that are similar to a pattern they meet (lh, n, cut, template, pattern): each one's best.

    Only similar pairs go on, and are reduced to a line's best before they are shuffled.
    """
    alike = F.size(F.filter(F.zip_with("cut", "pattern", lambda a, b: a == b), lambda x: x))
    near = met.where(alike >= similarity * F.size("cut") - 1e-9).select("lh", "n", F.struct(alike.alias("alike"), "template").alias("x"))
    return near.groupBy("lh", "n").agg(F.max("x")["template"].alias("template")).select("lh", "template", "n")


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 3,
    leading: int = 3,
    similarity: float = 0.7,
    min_tokens: int = 3,
    keep_first: bool = True,
    share: float | None = None,
    counts: tuple[str, str] | None = ("__lt_lines", "__lt_dropped"),
) -> DataFrame:
    """docs with the lines of recurring templates taken out of `text`; `counts` names columns for its lines and those dropped."""
    if clash := set(counts or ()) & set(docs.columns):
        raise ValueError(f"docs has columns {sorted(clash)}; name others for the counts")
    _, recurring, matched = found_lines(docs, min_docs, leading, similarity, min_tokens, 1_000_000, share)
    in_all = recurring.agg(F.sum("rows")).first()[0] or 0
    marked = joined(matched, recurring.select("template", "first", "rows"), ["template"], "rows", in_all)
    if keep_first:
        marked = marked.where(~(F.col("first")[ID].eqNullSafe(F.col(ID)) & (F.col("first")[HASH] == F.col(HASH))))
    drops = marked.groupBy(ID, HASH).agg(F.collect_set("lh").alias("gone"))
    boxed = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    met = boxed.join(drops, F.col("id").eqNullSafe(F.col(ID)) & (F.col("key") == F.col(HASH)), "left")
    text = F.col("row").getField("text")
    met = met.withColumn("parts", F.split(text, "\n"))
    left = F.when(F.col("gone").isNull(), F.col("parts")).otherwise(F.filter("parts", lambda x: ~F.array_contains("gone", F.xxhash64(x))))
    met = met.withColumn("left", left)
    new = F.when(F.col("gone").isNull(), text).otherwise(F.array_join("left", "\n"))
    columns = [(new if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns]
    if counts:
        columns.append(F.when(text.isNull(), 0).otherwise(F.size("parts")).alias(counts[0]))
        columns.append(F.when(text.isNull(), 0).otherwise(F.size("parts") - F.size("left")).alias(counts[1]))
    return met.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", F.col("__lt_lines").cast("long").alias("n_lines"), F.col("__lt_dropped").cast("long").alias("n_dropped"), "text")


SQL = r"""
WITH held AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL
), each_line AS (SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM held
), cut AS (SELECT *, list_filter(string_split(replace(replace(line, chr(9), ' '), chr(13), ' '), ' '), lambda t: t <> '') AS tk FROM each_line
), placed AS (
  SELECT *, len(tk) || '|' || array_to_string(list_transform(tk[1:3], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ') AS leaf FROM cut WHERE len(tk) >= 3
), recurring_leaf AS (SELECT leaf FROM placed GROUP BY leaf HAVING count(*) >= 3
), lines AS (SELECT leaf, line, count(*) AS n, any_value(tk) AS tk FROM placed JOIN recurring_leaf USING (leaf) GROUP BY leaf, line
), tok AS (SELECT leaf, line, n, len(tk) AS size, unnest(tk) AS token, unnest(range(len(tk))) AS place FROM lines
), constant AS (SELECT leaf, place, token FROM tok GROUP BY leaf, place, token HAVING sum(n) >= 3
), fixed AS (SELECT leaf, line, size, string_agg(place || ':' || token, ' ' ORDER BY place) AS kept, count(*) AS k FROM tok JOIN constant USING (leaf, place, token) GROUP BY leaf, line, size
), template_of AS (SELECT line, leaf || '#' || kept AS template FROM fixed WHERE k >= 0.7 * size
), recurring AS (
  SELECT template, min(doc_id) AS first_doc FROM (SELECT DISTINCT template, doc_id FROM each_line JOIN template_of USING (line)) h GROUP BY template HAVING count(*) >= 3
), gone AS (
  SELECT e.doc_id, list(e.line) AS lines FROM each_line e JOIN template_of t ON e.line = t.line JOIN recurring r ON t.template = r.template WHERE e.doc_id <> r.first_doc GROUP BY e.doc_id
), done AS (
  SELECT d.doc_id, string_split(d.text, chr(10)) AS parts, list_filter(string_split(d.text, chr(10)), lambda x: NOT coalesce(list_contains(g.lines, x), false)) AS kept_lines FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id
)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines, CAST(len(parts) - len(kept_lines) AS BIGINT) AS n_dropped, array_to_string(kept_lines, chr(10)) AS text FROM done
"""
