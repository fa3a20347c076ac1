r"""Secret scans over every historical version, through an incremental blob ledger.

A version's text is addressed by its SHA-256, so equal texts at many paths are
one blob.  The ledger records per blob which rule versions have seen it and
what they found.  A scan reads only blobs for which some current rule version
is missing, runs only the missing rules, appends to the ledger and joins the
findings back to all paths.

Everything is column expressions and joins on the blob's address.  A blob that
a third of all paths share is one row before the scan (pre-aggregated in the
map tasks); joined back, it is a skewed key that adaptive execution splits.

Defined results: a null text is the empty blob; texts of any length are scanned
whole; repeated rows each get their findings; an empty table gives an empty
one; columns of the input named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustweave.llm import spans as S
from trustweave.llm.shared import Scratch, beside, packed, restored, text_of

BASE = ("assign", "access", "hex")
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+"""


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    hint: str | None = None
    #: what a match must also fulfil
    valid: object = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, _ASSIGN + r"[A-Za-z0-9+/_.=-]++",
         valid=lambda m: F.length(F.regexp_replace(m, "^" + _ASSIGN, "")) >= 6),
    # shorter runs cannot pass and hold no match that could
    Rule("access", 1, "AKIA[A-Z0-9]{16,}+", hint="AKIA"),
    Rule("hex", 1, "(?<![0-9a-f])[0-9a-f]{24,}+"),
    Rule("private_key", 1, "-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", hint="-----BEGIN "),
    Rule("github", 1, "(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+", hint="gh"),
    Rule("slack", 1, "(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+", hint="xox"),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", hint="eyJ"),
)
SPANS = "array<struct<kind:string,start:int,end:int,text:string>>"
LEDGER = f"blob string, scanned array<string>, findings {SPANS}"


def _order(rules: tuple[Rule, ...], kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r.kind) for r in rules]), kind)


def in_order(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """By start, then kind as the rules list it."""
    key = lambda s: F.struct(s["start"].alias("start"), _order(rules, s["kind"]).alias("o"), s.alias("s"))
    return F.transform(F.array_sort(F.transform(spans, key)), lambda x: x["s"])


def address(text: Column) -> Column:
    return F.sha2(text, 256)


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, text, missing``: blobs that some rule version has not seen."""
    current = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        return blobs.withColumn("missing", current)
    known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("scanned"))
    left = blobs.join(known, "blob", "left")
    missing = F.array_except(current, F.coalesce("scanned", F.array().cast("array<string>")))
    return left.select("blob", "text", missing.alias("missing")).where(F.size("missing") > 0)


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, scanned, findings`` of ``blob, text, missing``."""
    none = lambda kind: F.array().cast(kind)
    wanted = lambda r, c, kind: F.when(F.array_contains("missing", r.name), c).otherwise(none(kind))
    rows = blobs.select("*", *[
        wanted(r, S.matches(F.col("text"), r.pattern, r.hint), "array<string>").alias(f"_m_{r.kind}") for r in rules])
    rows = rows.select("*", *[S.placed(F.col("text"), r.pattern, F.col(f"_m_{r.kind}")).alias(f"_p_{r.kind}") for r in rules])

    def of(r: Rule) -> Column:
        spans = F.col(f"_p_{r.kind}")
        spans = spans if r.valid is None else F.filter(spans, lambda s: r.valid(s["text"]))
        named = F.transform(spans, lambda s: F.struct(
            F.lit(r.kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
        return F.when(F.size(f"_p_{r.kind}") > 0, named).otherwise(none(SPANS))

    found = rows.select("blob", F.col("missing").alias("scanned"), F.flatten(F.array(*map(of, rules))).alias("findings"))
    return found.select("blob", "scanned", F.when(F.size("findings") > 1, in_order(F.col("findings"), rules)).otherwise(F.col("findings")).alias("findings"))


def find_secrets(versions: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, scratch: Scratch | None = None) -> DataFrame:
    """``versions`` with ``blob`` and ``secrets``, the spans of the current rule versions.

    ``ledger_path`` is a folder that keeps the ledger from scan to scan; without
    one, every blob is unseen.
    """
    spark = versions.sparkSession
    scratch = scratch or Scratch(spark, "secrets")
    path = ledger_path or f"{scratch.root}/ledger"
    ledger = spark.read.schema(LEDGER).parquet(path) if ledger_path and _exists(spark, path) else None
    text = text_of(versions)
    blobs = versions.select(address(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    scan(unseen(blobs, ledger, rules), rules).write.mode("append").parquet(path)

    names, kinds = [r.name for r in rules], [r.kind for r in rules]
    found = (
        spark.read.schema(LEDGER).parquet(path).where(F.size("findings") > 0)
        # of a kind's findings only those that a current rule version made
        .select(F.col("blob").alias("_blob"), F.explode(F.arrays_zip(F.col("scanned"))).alias("z"), "findings")
        .where(F.col("z.scanned").isin(names))
        .select("_blob", F.col("z.scanned").alias("by"), F.split("z.scanned", "@")[0].alias("kind"), "findings")
        .select("_blob", "by", F.filter("findings", lambda f: f["kind"] == F.col("kind")).alias("part"))
        .where(F.size("part") > 0)
        .groupBy("_blob").agg(F.collect_list("part").alias("parts"), F.collect_list("by").alias("by"))
        # two drivers may have scanned a blob with the same rule version: its first findings count
        .select("_blob", in_order(F.flatten(F.filter("parts", lambda _, i: F.array_position("by", F.get("by", i)) == i + 1)), rules).alias("_secrets"))
    )
    rows = packed(versions, blob=address(text_of(versions)))
    rows = rows.join(found, F.col("blob") == F.col("_blob"), "left")
    secrets = F.coalesce("_secrets", F.array().cast(SPANS))
    return rows.select(*beside(rows, ["blob", "secrets"]), "blob", secrets.alias("secrets"))


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by ``[kind]``; overlapping spans become one."""
    def cut(blocks: Column, own: Column, upto: Column) -> Column:
        """``upto`` is how far the spans up to each one reach."""
        def part(s: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(upto, i - 1))
            return S.let(before, lambda b: F.when(
                s["start"] >= b, F.concat(S.between(blocks, b, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit("")))

        return F.concat(F.array_join(F.transform(own, part), ""), F.substr(text, F.element_at(upto, -1) + 1))

    reach = S.running(F.transform(spans, lambda s: s["end"]), F.greatest)
    done = S.let(S.blocks(text), lambda blocks: S.let(reach, lambda upto: cut(blocks, spans, upto)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def without_secrets(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in a text replaced by its kind; ``n_chars`` follows."""
    found = find_secrets(packed(docs, "text", text=F.col("text")), ledger_path, rules)
    done = found.select("_doc", redacted(F.col("text"), F.col("secrets")).alias("text"), (F.size("secrets") > 0).alias("hit"))
    return restored(done, docs, F.col("hit"))


def digest(found: DataFrame) -> DataFrame:
    """One row per document: counts and digests of its spans."""
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    in_base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(S.digest(in_base), 256).alias("base_sha256"),
                        S.digest(F.col("secrets")).alias("spans"))
