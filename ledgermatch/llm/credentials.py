"""Secret scans with linking of credentials that come in several parts.

Base kinds are patterns that are telling by themselves. Weak kinds (an account
name, a long mixed token, an address) are everywhere in harmless text, so they are reported only
next to their complement: parts of one scope whose intervals lie within ``REACH`` code
points. An identifier needs a secret, a secret needs an identifier, an address needs both.
A scope is a block of lines between blank lines. Parts may overlap: an address that holds a token, an
account name with a long hexadecimal value; only what a base span covers completely is no part of its own.

Extraction is a small per-text helper. Linking is an interval join on Spark: the parts of a scope
in order, with running maxima and minima of the ends of their complements, so no pair of
parts is ever written out.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgermatch.llm.shared import materialise, text_key

#: Code points between complementary parts at most.
REACH = 300

# --- fixed values: the base kinds, their patterns and least lengths ---
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
# --- end of fixed values ---

#: Weak kinds in the order in which they follow the base kinds.
WEAK = {
    "account": re.compile(r"""\b(?:user|username|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII),
    "opaque": re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![A-Za-z0-9+/_=-])"),
    "endpoint": re.compile(r"\bhttps?://[A-Za-z0-9.-]+(?::[0-9]{2,5})?(?:/[^\s\"'<>]*)?|\b[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}\b", re.ASCII),
}
BASE = ["assign", "access", "hex"]
ORDER = {kind: i for i, kind in enumerate([*BASE, *WEAK])}
#: The part that each kind plays.
PART = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "opaque": "secret", "endpoint": "endpoint"}

_DIGITS, _HEX_WORD = re.compile(r"[0-9]"), re.compile(r"[a-f]{24}")
_BLANK = re.compile(r"\n[ \t\r\f\v]*\n")
_SPAN = pa.struct([("kind", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("scope", pa.int64())])


def _covered(strong: dict[int, list[tuple]], of: tuple) -> bool:
    """Whether one base span covers ``of`` completely.

    Spans of a kind are sorted and don't overlap, so of each kind only the last that begins no later can do so.
    """
    for spans in strong.values():
        at = bisect.bisect_right(spans, of[1], key=lambda s: s[1]) - 1
        if at >= 0 and spans[at][2] >= of[2]:
            return True
    return False


def find(text: str) -> list[dict]:
    """Spans of all kinds, leftmost and not overlapping within a kind, with the scope each lies in."""
    out = []
    # Every assignment has one of these signs, every access key its prefix; most texts have none of them.
    if ":" in text or "=" in text:
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
        out += [(ORDER["account"], *m.span()) for m in WEAK["account"].finditer(text)]
        if ":" in text:
            out += [(ORDER["endpoint"], *m.span()) for m in WEAK["endpoint"].finditer(text)]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    if _DIGITS.search(text):
        out += [(2, *m.span()) for m in HEX.finditer(text)]
        out += [(ORDER["opaque"], *m.span()) for m in WEAK["opaque"].finditer(text)]
    elif _HEX_WORD.search(text):
        out += [(2, *m.span()) for m in HEX.finditer(text)]
    if not out:
        return out
    out.sort(key=lambda s: (s[1], s[0]))
    strong = {kind: [s for s in out if s[0] == kind] for kind in range(len(BASE))}
    # What one base span covers completely is no weak candidate as well.
    out = [s for s in out if s[0] < len(BASE) or not _covered(strong, s)]
    cuts, scope, found = [m.start() for m in _BLANK.finditer(text)], 0, []
    for kind, first, last in out:
        while scope < len(cuts) and cuts[scope] < first:
            scope += 1
        found.append({"kind": kind, "first": first, "last": last, "scope": scope})
    return found


@F.arrow_udf(T.ArrayType(T.StructType().add("kind", "integer").add("first", "long").add("last", "long").add("scope", "long")))
def spans(text: pa.Array) -> pa.Array:
    """Candidate spans of every whole text; none for NULL."""
    return pa.array([find(t.as_py() or "") for t in text], pa.list_(_SPAN))


def as_text(rows: Column) -> Column:
    """Spans as kind:first:last, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, ORDER)), k + 1)
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", name(s["kind"]), s["first"], s["last"])), ",")


def _plays(part: str) -> Column:
    return F.col("s.kind").isin(*(ORDER[k] for k, p in PART.items() if p == part))


def linked(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, key1, key2 and ``links``, the weak spans with their complement within reach, of texts that have any."""
    weak = F.exists("spans", lambda s: s["kind"] >= len(BASE))
    parts = (
        scanned.where(weak & (F.size("spans") > 1))
        .select("doc_id", "key1", "key2", "spans")
        .distinct()  # rows that share doc_id and text
        .select("doc_id", "key1", "key2", F.explode("spans").alias("s"))
    )
    scope = Window.partitionBy("doc_id", "key1", "key2", "s.scope").orderBy("s.first", "s.kind")
    back = Window.partitionBy("doc_id", "key1", "key2", "s.scope").orderBy(F.desc("s.first"), F.desc("s.kind"))
    ahead, behind = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (scope, back))

    def near(part: str) -> Column:
        left = F.max(F.when(_plays(part), F.col("s.last"))).over(ahead)
        right = F.min(F.when(_plays(part), F.col("s.first"))).over(behind)
        return F.coalesce(F.col("s.first") - left <= reach, F.lit(False)) | F.coalesce(right - F.col("s.last") <= reach, F.lit(False))

    seen = parts.select("*", near("identifier").alias("by_identifier"), near("secret").alias("by_secret"))
    complete = (
        (_plays("identifier") & F.col("by_secret"))
        | (_plays("secret") & F.col("by_identifier"))
        | (_plays("endpoint") & F.col("by_identifier") & F.col("by_secret"))
    )
    return (
        seen.where((F.col("s.kind") >= len(BASE)) & complete)
        .groupBy("doc_id", "key1", "key2")
        .agg(F.collect_list("s").alias("links"))
    )


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, base (spans of the base kinds) and all_spans (with the linked weak ones) of every document.

    Spans are (kind, first, last, scope) in order of first, then kind, in code points, end exclusive.
    NULL or empty text has none. Repeated rows come out alike.
    """
    scanned = materialise(docs.select("doc_id", *text_key(), spans("text").alias("spans")), "spans")
    links = linked(scanned, reach).select(F.col("doc_id").alias("of"), F.col("key1").alias("of1"), F.col("key2").alias("of2"), "links")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key1") == F.col("of1")) & (F.col("key2") == F.col("of2"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    order = lambda a: F.transform(
        F.array_sort(F.transform(a, lambda s: F.struct(s["first"].alias("first"), s["kind"].alias("kind"), s["last"].alias("last"), s["scope"].alias("scope")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["first"].alias("first"), s["last"].alias("last"), s["scope"].alias("scope")),
    )
    return scanned.join(links, same, "left").select(
        "doc_id", base.alias("base"), order(F.concat(base, F.coalesce("links", F.array().cast("array<struct<kind:int,first:long,last:long,scope:long>>")))).alias("all_spans")
    )
