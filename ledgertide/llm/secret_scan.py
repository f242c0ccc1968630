"""Secret scans: spans of likely credentials, and how widely each candidate value is owned.

DataFrame functions only. Spans come from splitting a text at a pattern and adding up the lengths of what lies
between and of the matches. Every candidate value is hashed and counted by distinct repositories and owners over the
whole corpus: a value that many owners carry is a copied example, one that a single owner carries looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.llm.common import written

_WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"({_WORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Runs of the two classes are maximal, so the least length can stand in the pattern itself.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: Unlabelled candidates: long runs with a digit, a letter and no dots; they count only if one owner has them.
LOOSE = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
COPIED_OWNERS, SALT = 3, 16


def _bound(value: Column, use) -> Column:
    """use(value) with value evaluated once: a one-element array binds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(items: Column, zero: Column, step) -> Column:
    """What step has made of zero and all items up to each one. In chunks of about the square root of their number, so
    that lists grow by chunks and not by items.
    """
    empty = F.slice(F.array(zero), 1, 0)

    def chunk(last: Column, own: Column) -> Column:
        grow = lambda done, x: _bound(step(done["last"], x), lambda now: F.struct(F.concat(done["out"], F.array(now)).alias("out"), now.alias("last")))
        return F.aggregate(own, F.struct(empty.alias("out"), last.alias("last")), grow)

    def whole(own: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(own))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda k: F.slice(own, k * size + 1, size))
        join = lambda done, part: _bound(chunk(done["last"], part), lambda now: F.struct(F.concat(done["out"], now["out"]).alias("out"), now["last"].alias("last")))
        return F.aggregate(chunks, F.struct(empty.alias("out"), zero.alias("last")), join, lambda done: done["out"])

    return _bound(items, whole)


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<start, end, kind, value>> of all matches; offsets in code points, end exclusive."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(s: Column) -> Column:
        ends = _running(F.transform(s["hits"], lambda hit, k: s["gaps"][k] + F.length(hit)), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.zip_with(s["hits"], ends, lambda hit, end: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), hit.alias("value")))

    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, kind: string, value: string>>)")
    return F.when(F.rlike(text, F.lit(pattern)), _bound(F.struct(between.alias("gaps"), hits.alias("hits")), place)).otherwise(none)


def _apart(loose: Column, base: Column) -> Column:
    """The loose spans that no base span overlaps; both lists are sorted by start, and so is the result.

    Along the merged list, the largest end of a base span so far and the least start of one from here on decide.
    """

    def solve(both: Column) -> Column:
        top = F.lit(2**62)
        past = _running(both, F.lit(0).cast("long"), lambda a, s: F.when(s["base"], F.greatest(a, s["end"])).otherwise(a))
        ahead = F.reverse(_running(F.reverse(both), top.cast("long"), lambda a, s: F.when(s["base"], F.least(a, s["start"])).otherwise(a)))
        kept = F.zip_with(F.zip_with(both, past, lambda s, p: F.struct(s.alias("s"), p.alias("past"))), ahead, lambda x, n: F.struct(x["s"].alias("s"), (~x["s"]["base"] & (x["past"] <= x["s"]["start"]) & (n >= x["s"]["end"])).alias("keep")))
        return F.transform(F.filter(kept, lambda x: x["keep"]), lambda x: x["s"]["span"])

    mark = lambda spans, flag: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(flag).alias("base"), s.alias("span")))
    merged = F.array_sort(F.concat(mark(base, True), mark(loose, False)))
    return F.when((F.size(loose) == 0) | (F.size(base) == 0), loose).otherwise(_bound(merged, solve))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _sorted(spans: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    return F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))


def candidate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """(row, doc_id, owner, repo, base, loose): spans of every row; the text itself is not carried on."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), text.alias("text"))
    found = rows.select(
        "doc_id",
        "owner",
        "repo",
        F.filter(_spans(F.col("text"), "assign", ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8).alias("assign"),
        _spans(F.col("text"), "access", ACCESS).alias("access"),
        _spans(F.col("text"), "hex", HEX).alias("hex"),
        F.filter(_spans(F.col("text"), "owned", LOOSE), lambda s: F.rlike(s["value"], F.lit("[0-9]")) & F.rlike(s["value"], F.lit("[A-Za-z]"))).alias("loose"),
    )
    found = found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", _sorted(F.concat("assign", "access", "hex")).alias("base"), "loose")
    return found.withColumn("loose", _apart(F.col("loose"), F.col("base")))


def _value(s: Column) -> Column:
    """What identifies a candidate: the value itself, without the name it is assigned to."""
    return F.when(s["kind"] == "assign", F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"])


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners): distinct repositories and owners of every candidate value; null owners count as one."""
    each = spans.select("owner", "repo", F.explode(F.concat("base", "loose")).alias("s")).select(F.sha2(_value(F.col("s")).cast("binary"), 256).alias("hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"))
    by_owner = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """(row, doc_id, base, spans, n_live, n_copied): one row for each row of docs.

    base: spans of the three base patterns. spans: these and the loose candidates that a single owner carries (kind
    owned). Each span says how many owners and repositories its value has; it is live if they are one owner, copied
    from `copied_owners` owners on. Owners that are null count as one. Null texts are empty; repeated ids are separate rows. Very long texts are scanned
    whole. An empty table gives no rows. Columns other than the four are not read, whatever their names.
    """
    found = written(candidate_spans(docs, id_col, text_col, owner_col, repo_col), "spans")
    owned = ownership(found)
    each = found.select("row", F.explode(F.concat("base", "loose")).alias("s")).withColumn("hash", F.sha2(_value(F.col("s")).cast("binary"), 256))
    each = each.withColumn("salt", F.pmod("row", F.lit(SALT)))  # a value that a third of the rows carry goes to several tasks
    owned = owned.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    each = each.join(owned, ["hash", "salt"]).where("s.kind <> 'owned' or n_owners = 1")
    full = F.struct(F.col("s.start").alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("s.kind")).alias("rank"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), "hash", "n_owners", "n_repos")
    by_row = each.groupBy("row").agg(F.array_sort(F.collect_list(full)).alias("spans"), F.sum((F.col("n_owners") == 1).cast("long")).alias("n_live"), F.sum((F.col("n_owners") >= copied_owners).cast("long")).alias("n_copied"))
    out = found.select("row", "doc_id", "base").join(by_row, "row", "left")
    none = F.expr("cast(array() as array<struct<start: bigint, rank: bigint, end: bigint, kind: string, hash: string, n_owners: bigint, n_repos: bigint>>)")
    return out.select("row", "doc_id", "base", F.coalesce("spans", none).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def secret_digests(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    found = secret_scan(docs, **columns)
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_live", "n_copied")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", copied_owners: int = COPIED_OWNERS, mask: str = "[secret]") -> DataFrame:
    """docs with live-looking secrets masked: spans of values that fewer than copied_owners owners carry.

    Widely copied examples stay, and so do rows without candidates. Spans that overlap are masked as one; null texts
    stay null. Only rows with a candidate are joined with their spans; all other rows stay where they are. Repeated rows
    and ids are each masked, and docs may have columns of any names.
    """
    text = F.col(text_col).cast("string")
    names = [n for n in (f"__{k}" for k in range(len(docs.columns) + 2)) if n not in docs.columns]
    key, spans = names[0], names[1]  # no column of docs has these
    any_hit = F.rlike(F.coalesce(text, F.lit("")), F.lit("|".join(f"(?:{p})" for p in (ASSIGN, ACCESS, LOOSE))))
    some = docs.where(any_hit).withColumn(key, F.xxhash64(F.col(id_col), text))
    plain = some.select(F.col(key).alias("id"), F.col(text_col).alias("text"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"))
    found = secret_scan(plain, "id", "text", "owner", "repo", copied_owners)
    live = found.select(F.col("doc_id").alias(key), F.filter("spans", lambda s: s["n_owners"] < copied_owners).alias(spans)).where(F.size(spans) > 0).dropDuplicates([key])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        between = F.substring(text, (done["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - done["at"]).cast("int"))
        fresh = F.when(s["start"] >= done["at"], F.lit(mask)).otherwise(F.lit(""))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], between, fresh).alias("out"))

    whole = lambda done: F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
    masked = some.join(live, key, "left").withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(F.aggregate(spans, start, step, whole)))
    return docs.where(~any_hit).unionByName(masked.select(docs.columns))
