"""Secret scans through an inverted index of trigrams.

A Boolean query over trigrams is derived from each rule's regular expression: every text
that matches the expression must satisfy the query. Postings (trigram, document) are kept
for the trigrams that occur in some query; grouping them by document intersects them and
leaves the candidates of each rule. Candidates are verified by the expression itself. A
rule whose expression forces no trigram scans all texts.

Postings of a frequent trigram are spread by document, never by trigram, so none is hot.
Everything is a column expression; texts are moved at most once, for the join with their
candidates, and not at all where the candidates are few enough to be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as K, _parser as parser  # type: ignore[attr-defined]

from pyspark.sql import Column, DataFrame, functions as F

from deltascope.llm.common import let, materialize

MASK = "[redacted]"


def either_case(word: str) -> str:
    """A pattern for an ASCII word in upper or lower case, letter by letter."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and non-overlapping, whose `group` has at least `least` characters.

    `fast` matches the same with possessive loops: no recursion, however long the match.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fast: str = ""


# fixed patterns of the base kinds; the last two have their least length in the pattern
_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + f"|{either_case('api')}_?{either_case('key')}"
BASE_RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)


def _private_key(p: str) -> str:
    """A whole private key: from its header to its END line, or, where that is missing, as far as
    header fields and runs of base64 go and one word more, since the last line may be short.

    `p` makes loops possessive where the engine has that."""
    gap = rf"(?:[ \t\r\n\"'`,>#*|]|\\[nrt]?)*{p}"
    ended = rf"[^-]*{p}(?:-{{1,4}}{p}[^-]+{p})*{p}-----END [A-Z ]{{0,30}}PRIVATE KEY(?: BLOCK)?-----"
    fields = rf"(?:{gap}[A-Za-z][A-Za-z0-9-]*{p}:[^\r\n\\]*{p})*{p}"
    runs = rf"(?:{gap}[A-Za-z0-9+/]{{16,}}{p}={{0,2}}{p})+{p}(?:{gap}[A-Za-z0-9+/]+{p}={{0,2}}{p})?{p}"
    return rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY(?: BLOCK)?-----(?:{ended}|(?:{fields}{runs})?)"


_WORDS = [
    "secret[_-]access[_-]key", "access[_-]secret", "secret[_-]key", "private[_-]key", "access[_-]key", "client[_-]secret",
    "access[_-]token", "auth[_-]token", "encryption[_-]key",
]
_KEY_NAMES = "|".join("[_-]".join(map(either_case, w.split("[_-]"))) for w in _WORDS) + "|secretAccessKey|secretKey|privateKey|accessKey|encryptionKey"
#: Well-known shapes of keys, added to the base kinds.
RULES = BASE_RULES + (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", _private_key(""), fast=_private_key("+")),
    Rule("temporary", r"ASIA[A-Z0-9]{14,}"),
    Rule("key_assign", rf"({_KEY_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
)

# --- trigram queries: a trigram, ("and", parts), ("or", parts), or None for "any text"

MOST_STRINGS = 64  # sets of exact strings larger than this are turned into a query


def both(*parts):
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def either(*parts):
    return None if any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("or", list(parts))


def of_strings(strings: Iterable[str]):
    """Query of a text that holds one of the strings."""
    grams = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    least = sorted((sorted(g) for g in grams if not any(h < g for h in grams)))
    return either(*[both(*g) for g in least]) if least else None


def _analyse(tree):
    """(the strings this matches exactly, or None; the query of a text with a match), lower-cased."""
    query, run, exact = None, {""}, True
    for op, arg in tree:
        strings, part = _one(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        query, exact = both(query, of_strings(run), part), False
        run = strings if strings is not None else {""}
    return (run, None) if exact else (None, both(query, of_strings(run)))


def _one(op, arg):
    if op is K.LITERAL:
        return {chr(arg).lower()}, None
    if op is K.IN:
        letters = {chr(a).lower() for o, a in arg if o is K.LITERAL}
        return (letters, None) if all(o is K.LITERAL for o, _ in arg) and len(letters) <= 5 else (None, None)
    if op is K.SUBPATTERN:
        return _analyse(arg[-1])
    if op is K.BRANCH:
        found = [_analyse(branch) for branch in arg[1]]
        if all(strings is not None for strings, _ in found):
            return set().union(*(strings for strings, _ in found)), None
        return None, either(*[of_strings(s) if s is not None else q for s, q in found])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        least, most, sub = arg
        strings, query = _analyse(sub)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, None
        if least == 0:
            return None, None
        return None, of_strings(strings) if strings is not None else query
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return {""}, None
    return None, None


def trigram_query(pattern: str):
    """What trigrams a text must hold to match; None if the pattern forces none."""
    strings, query = _analyse(parser.parse(pattern))
    return of_strings(strings) if strings is not None else query


def trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _holds(query, present: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(present, query)
    parts = [_holds(q, present) for q in query[1]]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


# --- index, candidates, verification


def build_postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, _id) for every trigram that some rule's query mentions, as a written table."""
    wanted = sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))
    listed = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
    found = let(F.lower("_text"), lambda text: F.filter(listed, lambda gram: F.contains(text, gram)))
    return materialize(docs.select("_id", F.explode(found).alias("trigram")), "trigram-postings")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_id, _kinds): the rules whose trigram query a document satisfies; documents without any are left out."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    kinds = [F.when(_holds(q, F.col("present")), F.lit(kind)) for kind, q in queries.items() if q is not None]
    if not kinds:
        return postings.select("_id", F.array().cast("array<string>").alias("_kinds")).limit(0)
    present = postings.groupBy("_id").agg(F.collect_set("trigram").alias("present"))
    found = present.select("_id", F.array_compact(F.array(*kinds)).alias("_kinds")).where(F.size("_kinds") > 0)
    return materialize(found, "secret-candidates")


def _before(lengths: Column) -> Column:
    """Sum of all earlier entries, for each entry; by blocks, so that thousands of matches stay cheap."""
    zero = F.lit(0).cast("long")

    def total(a: Column) -> Column:
        return F.aggregate(a, zero, lambda t, x: t + x)

    def sums(a: Column, block: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda k: total(F.slice(a, k * block + 1, block)))
        return let(blocks, lambda b: let(
            F.transform(b, lambda _, k: total(F.slice(b, F.lit(1), k))),
            lambda base: F.transform(a, lambda _, i: let(
                F.floor(i / block).cast("int"),
                lambda k: F.get(base, k) + total(F.slice(a, k * block + 1, i - k * block)),
            )),
        ))

    return F.when(F.size(lengths) > 0, let(lengths, lambda a: let(
        F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int"), lambda block: sums(a, block)
    ))).otherwise(F.array().cast("array<bigint>"))


def _matches(text: Column, rule: Rule) -> Column:
    """Gaps and matches of a rule: the text is gap, match, gap, match, ..., gap."""
    pattern = rule.fast or rule.pattern
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if rule.group else groups
    return F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("hits"), groups.alias("groups"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    def located(m: Column) -> Column:
        sizes = F.transform(m["hits"], lambda h, i: (F.length(F.get(m["gaps"], i)) + F.length(h)).cast("long"))
        return let(_before(sizes), lambda before: F.filter(
            F.transform(m["hits"], lambda h, i: F.when(
                F.length(F.get(m["groups"], i)) >= rule.least,
                let(F.get(before, i) + F.length(F.get(m["gaps"], i)), lambda start: F.struct(
                    start.alias("start"), F.lit(order).alias("_order"), (start + F.length(h)).alias("end"), F.lit(rule.kind).alias("kind")
                )),
            )),
            lambda span: span.isNotNull(),
        ))

    return F.when(text.rlike(rule.fast or rule.pattern), let(_matches(text, rule), located))


def _masked(text: Column, rule: Rule) -> Column:
    def rebuilt(m: Column) -> Column:
        parts = F.transform(m["gaps"], lambda gap, i: F.concat(
            gap, F.coalesce(F.when(F.length(F.get(m["groups"], i)) >= rule.least, F.lit(MASK)).otherwise(F.get(m["hits"], i)), F.lit(""))
        ))
        return F.array_join(parts, "")

    return F.when(text.rlike(rule.fast or rule.pattern), let(_matches(text, rule), rebuilt)).otherwise(text)


def _with_candidates(docs: DataFrame, id_column: str, text_column: str, rules: tuple[Rule, ...]) -> DataFrame:
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col(f"`{id_column}`").alias("_id"),
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("_text"),
    )
    found = candidates(build_postings(keyed.select("_id", "_text"), rules), rules).withColumnRenamed("_id", "_found")
    return keyed.join(found, keyed["_id"].eqNullSafe(found["_found"]), "left")


def _possible(rule: Rule) -> Column:
    return F.lit(True) if trigram_query(rule.pattern) is None else F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False))


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Find secrets in every whole text: one row per row of `docs`, its columns in the struct `_doc`.

    `spans` holds kind, start and end (code points, end exclusive) of each match, by start,
    then in the order of the rules. Spans of different kinds may overlap.

    Null text counts as empty and has no spans. Rows may share an id, or have none: their
    candidates are then pooled, and each row is verified on its own text. Very long texts
    are scanned whole. Extra columns stay inside the struct and can't clash. An empty table
    gives no rows.
    """
    rows = _with_candidates(docs, id_column, text_column, rules)
    found = [F.coalesce(F.when(_possible(r), _spans(F.col("_text"), r, i)), _no_spans()) for i, r in enumerate(rules)]
    spans = F.transform(F.sort_array(F.flatten(F.array(*found))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("_doc", spans.alias("spans"))


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:bigint,_order:int,end:bigint,kind:string>>")


def redact_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every secret replaced by `MASK`; null texts stay null, other columns as they are.

    A private key goes whole, up to its END line or as far as its base64 goes.
    """
    rows = _with_candidates(docs, id_column, text_column, rules)
    # whole keys first, before a mask inside them splits what they are told by
    for rule in sorted(rules, key=lambda r: not r.fast):
        rows = rows.withColumn("_text", F.when(_possible(rule), _masked(F.col("_text"), rule)).otherwise(F.col("_text")))
    original = F.col("_doc").getField(text_column)
    return rows.select(*[
        F.when(original.isNotNull(), F.col("_text")).alias(c) if c == text_column else F.col("_doc").getField(c).alias(c) for c in docs.columns
    ])
