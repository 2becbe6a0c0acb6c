"""Secret scans through an incremental blob ledger (DataFrame functions only).

Every version of every path is addressed by the hash of its content.  A ledger
remembers which blob was scanned under which version of which rule; a run
scans unseen pairs only, appends what it found, and joins findings back to all
paths that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlab.llm.common import Scratch, bounded

#: Most row ids that are broadcast to pick the rows to scan.
ID_BOUND = 1_000_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``pattern`` is searched leftmost and non-overlapping; ``group`` must have ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False
    version: int = 1
    #: A cheap test that every text with a match passes.
    hint: str = ""


# Kinds and patterns of the base rules, in their listed order.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=8,
        group=2,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
)
#: Further public credential formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("repo_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
)
RULES = BASE_RULES + MORE_RULES


def rule_spans(body: Column, rule: Rule) -> Column:
    """Spans (start, end) of a rule in code points, end exclusive, as an array.

    Splitting by the pattern and extracting it give the pieces between matches
    and the matches; running lengths of the two give the places.
    """
    gaps = F.transform(F.split(body, rule.pattern), F.char_length)
    found = F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(0))
    if rule.least:
        wide = lambda m: F.char_length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least
    else:
        wide = lambda m: F.lit(True)
    sized = F.transform(found, lambda m: F.struct(F.char_length(m).alias("n"), wide(m).alias("ok")))
    pairs = F.arrays_zip(gaps.alias("gap"), sized.alias("hit"))
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        end = start + F.coalesce(pair["hit"]["n"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(F.coalesce(pair["hit"]["ok"], F.lit(False)), F.concat(acc["spans"], one)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    spans = F.aggregate(pairs, zero, step, lambda acc: acc["spans"])
    may = body.contains(rule.hint) & body.rlike(rule.pattern) if rule.hint else body.rlike(rule.pattern)
    return F.when(may, spans).otherwise(F.array().cast(kind))


def blobs_of(df: DataFrame, path_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(path_col).alias("path_id"), F.sha2(body, 256).alias("blob"))


def scan(
    df: DataFrame, ledger: DataFrame | None = None, path_col: str = "doc_id", text_col: str = "text",
    rules: tuple[Rule, ...] = RULES, id_bound: int = ID_BOUND,
) -> tuple[DataFrame, DataFrame]:
    """Scan what ``ledger`` hasn't seen: (paths with findings, new ledger rows).

    Ledger rows are (blob, kind, version, spans), also where nothing was found.
    One row per blob is read: the smallest path id of each.  Which rows those
    are reaches the texts as a broadcast of (path id, blob) (of the rows to scan
    or of those to skip, whichever are fewer) if they are at most ``id_bound``,
    and beyond it by a shuffled join; the texts of skipped rows are never
    searched.  A path may hold several versions: rows are told apart by both.
    The blob table is an aggregate that combines before the shuffle, and the
    join back is split by adaptive execution where a blob is hot.

    Null texts are the empty blob.  Rows that repeat path and text give equal
    rows.  An empty table gives empty results.
    """
    work = Scratch(df.sparkSession, "secret-ledger")
    paths = work.save(blobs_of(df, path_col, text_col), "paths")
    firsts = paths.groupBy("blob").agg(F.min("path_id").alias("path_id"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        todo = firsts.select(F.unhex("blob").alias("blob"), "path_id", F.lit((1 << len(rules)) - 1).alias("mask"))
    else:
        pairs = firsts.select("blob", "path_id", F.explode(wanted).alias("rule")).select("blob", "path_id", "rule.*")
        pairs = pairs.join(ledger.select("blob", "kind", "version").distinct(), ["blob", "kind", "version"], "left_anti")
        bit = F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, 1 << k)]), F.col("kind"))
        todo = pairs.groupBy("blob").agg(F.first("path_id").alias("path_id"), F.sum(bit).cast("int").alias("mask"))
        todo = todo.select(F.unhex("blob").alias("blob"), "path_id", "mask")  # as narrow as it can be sent
    todo = work.save(todo, "todo")
    texts = df.select(F.col(path_col).alias("path_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    texts = texts.withColumn("blob", F.sha2("body", 256))
    version = lambda w: F.col("t.path_id").eqNullSafe(F.col(f"{w}.path_id")) & (F.unhex("t.blob") == F.col(f"{w}.blob"))
    n_rows, n_todo = paths.count(), todo.count()
    every = ledger is None
    if n_todo <= id_bound and not (every and n_rows - n_todo < n_todo):
        work_rows = texts.alias("t").join(F.broadcast(todo).alias("w"), version("w")).select("t.blob", "w.mask", "t.body")
    elif every and n_rows - n_todo <= id_bound:
        held = paths.select("path_id", F.unhex("blob").alias("blob"))
        skip = work.save(held.join(todo.select("blob", "path_id").withColumn("__first", F.lit(True)), ["blob", "path_id"], "left")
                         .filter(F.col("__first").isNull() & F.col("path_id").isNotNull()).select("path_id", "blob"), "skip")
        work_rows = texts.alias("t").join(F.broadcast(skip).alias("s"), version("s"), "left_anti")
        work_rows = work_rows.select("blob", F.lit((1 << len(rules)) - 1).alias("mask"), "body")
    else:
        work_rows = texts.alias("t").join(todo.alias("w"), version("w")).select("t.blob", "w.mask", "t.body")
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    results = F.array(
        *[
            F.struct(
                F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, rule_spans(F.col("body"), r)).otherwise(none).alias("spans"),
            )
            for k, r in enumerate(rules)
        ]
    )
    scanned = work_rows.select("blob", F.filter(results, lambda r: r["spans"].isNotNull()).alias("results"))
    scanned = work.save(scanned.dropDuplicates(["blob"]), "scanned")  # rows that repeat a path and its text
    fresh = scanned.select("blob", F.inline("results"))
    known = fresh if ledger is None else fresh.unionByName(ledger.select("blob", "kind", "version", "spans"))
    current = F.array(*[F.concat_ws(":", F.lit(r.kind), F.lit(r.version)) for r in rules])
    hits = known.filter((F.size("spans") > 0) & F.array_contains(current, F.concat_ws(":", "kind", "version")))
    hits = hits.dropDuplicates(["blob", "kind", "version"]).groupBy("blob").agg(F.collect_list(F.struct("kind", "spans")).alias("findings"))
    hits = work.save(hits, "hits")
    found = paths.join(bounded(hits, id_bound // 10), "blob", "left").select("path_id", "blob", "findings")
    return found, fresh


def scan_in_steps(
    df: DataFrame, cuts: list, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, id_bound: int = ID_BOUND
) -> tuple[DataFrame, DataFrame]:
    """``scan`` of a table that grows: up to each of ``cuts`` (path ids, ascending), then whole; (paths with findings, ledger).

    Each step enters into the ledger what it alone has seen, so a blob that
    comes back later, under whatever path, isn't searched again.  Rows without
    a path come with the last step.
    """
    work, ledger = Scratch(df.sparkSession, "ledger"), None
    for k, cut in enumerate([*cuts, None]):
        rows = df if cut is None else df.filter(F.col(path_col) <= F.lit(cut))
        found, fresh = scan(rows, ledger, path_col, text_col, rules, id_bound)
        ledger = work.save(fresh if ledger is None else ledger.unionByName(fresh), f"ledger{k}")
    return found, ledger


def ordered_spans(findings: Column, rules: tuple[Rule, ...]) -> Column:
    """Findings of the given rules as (start, place of the rule, end, kind), sorted."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    flat = F.flatten(
        F.transform(
            F.filter(F.coalesce(findings, F.array().cast("array<struct<kind:string,spans:array<struct<start:int,end:int>>>>")),
                     lambda f: F.array_contains(kinds, f["kind"])),
            lambda f: F.transform(
                f["spans"],
                lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, f["kind"]).alias("place"), s["end"].alias("end"), f["kind"].alias("kind")),
            ),
        )
    )
    return F.array_sort(flat)


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
