"""Postal addresses of one location (problem 6).

An address is read into house number, street words, postcode and the texts that
may be its town.  Rewrites are then mined from addresses that agree elsewhere:
towns that stand on the same postcodes, street words that stand at the same
number and name of the same town.  A rewrite is kept if the pair is seen together
more often than chance allows, by a likelihood ratio corrected for the number of
pairs tested, and covers a good share of what is rewritten; the addresses are
written anew and mined again until no rewrite is new.  Last, street names of the
same town, number and kind are joined within a few typing errors.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.names import CRITICAL, distance, likelihood_ratio, pairs, roots, spellings
from ledgerloom.llm.tries import errors_allowed, near
from ledgerloom.session import written

#: Kinds of street that need no mining.
KINDS = ("street", "road", "avenue", "lane", "drive", "square", "close", "boulevard", "court", "way", "terrace", "place", "rue", "chemin", "quai", "strasse", "platz", "weg", "allee", "gasse", "ufer", "plaza", "crescent", "parkway", "highway")
#: Kinds that stand before the name, and small words that belong to a name behind them.
LEADING = ("rue", "chemin", "quai", "avenue", "boulevard", "place", "allee")
SMALL = ("de", "du", "des", "la", "le", "les", "l'", "d'", "saint", "sainte", "st", "ste")
#: Kinds that German writes onto the name, with their short forms.
JOINED = {"strasse": "strasse", "platz": "platz", "weg": "weg", "allee": "allee", "gasse": "gasse", "str": "strasse", "pl": "platz"}
#: A rewrite must be seen on so many streets, and cover such a share of the rarer word, besides the test against chance.
LEAST_STREETS, LEAST_SHARE = 3, 0.12
_INSIDE = re.compile(r"\b(?:unit|suite|ste|apt|apartment|room|rm|floor|fl|etage|etg|stock|bldg|building|block|c/o|attn:?)\s*[:.]?\s*(?:accounts|#?\d+[a-z]?|[a-z])\b|\b\d+(?:st|nd|rd|th|er|e)\s+(?:floor|etage)\b|\b(?:hinterhaus|vorderhaus|erdgeschoss|ground floor)\b|\battn:?\s*[a-z ]+")
_NUMBER = re.compile(r"(?:\b(?:no|nr|num|n)\b\s*[.°º]?\s*|[#°º]\s*|n°\s*)?\b(\d{1,4})\s*(?:-\s*)?(?:([a-h])\b(?![.']))?(?![\d])")


_MISREAD = [(d, x, re.compile(rf"(?<=[a-z]){d}(?=[a-z])|(?<=[a-z]{{2}}){d}(?!\d)|(?<![\da-z]){d}(?=[a-z]{{2}})")) for d, x in (("0", "o"), ("1", "l"), ("5", "s"))]


def _plain(text: str) -> str:
    """As for names, but digits stay digits where they may be a house number."""
    s = text.casefold()
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s.replace("ø", "o").replace("ł", "l").replace("ß", "ss"))
        s = "".join(c for c in s if not unicodedata.combining(c))
    for digit, letter, pattern in _MISREAD:
        if digit in s:
            s = pattern.sub(letter, s)
    return s.replace("rn", "m")


def _kind(word: str) -> str | None:
    if word in KINDS:
        return word
    if len(word) >= 5:
        best = min((distance(word, k, 2), k) for k in KINDS if len(k) >= 4)
        if best[0] <= (1 if len(word) < 7 else 2):
            return best[1]
    return None


def _joined(word: str) -> tuple[str, str] | None:
    """Name and kind of a street written as one word; a short end counts only with its dot."""
    bare = word.rstrip(".")
    for end, full in JOINED.items():
        if bare.endswith(end) and len(bare) - len(end) >= 4 and (end not in ("str", "pl") or word.endswith(".")):
            return bare[: -len(end)], full
    return None


def read(spelling: str) -> dict | None:
    """Number, kind, name, postcode and possible towns of an address; null if it has no number or no street."""
    s = _plain(spelling).replace("’", "'")
    parts = [re.sub(r"\s+", " ", p).strip(" ,-") for p in re.split(r"[,;|\n]| - ", _INSIDE.sub(",", s))]  # what is inside a building parts the street from the town
    parts = [p for p in parts if p.strip(" .")]
    postcode, towns, beside, street = None, [], None, None
    number = letter = None
    front = back = ""
    loose: list[str] = []
    follows = None  # the part after a number that stands alone
    for at, p in enumerate(parts):
        m = re.search(r"\b(\d{5})\b", p)
        if m and postcode is None:
            postcode = m[1]
            before, after = p[: m.start()].strip(), p[m.end() :].strip()
            if after and not re.search(r"\d", after):
                beside, p = after, before
            elif re.fullmatch(r"[a-z]{2}", before) and at and not re.search(r"\d", parts[at - 1]):
                beside, p = parts[at - 1], after if re.search(r"\d", after) else ""
            elif not before or re.fullmatch(r"[a-z]{2}", before):
                p = after
            elif after or re.search(r"\d", before) or (number is not None and street == ""):
                p = before + " " + after
            else:
                beside, p = re.sub(r"\b[a-z]{2}$", "", before).strip(), ""
        if number is None and (n := _NUMBER.search(p)):
            number, letter = n[1].lstrip("0"), n[2] or ""
            front, back = p[: n.start()].strip(" ,-#°"), p[n.end() :].strip(" ,-#°")
            street = (front + " " + back).strip()
            follows = len(loose)
        elif p:
            loose.append(p)
    if number is None:
        return None
    words = lambda x: re.findall(r"[a-z']+\.?", x)
    if street == "" and loose:  # the number stands alone: the street is beside it
        i = follows if follows < len(loose) else follows - 1
        front, back = "", loose[i]
        loose = loose[:i] + loose[i + 1 :]
    # a town may stand before or after the street in one part with it
    tokens, others = (words(back), words(front)) if words(back) else (words(front), [])
    if others and not any(w.rstrip(".") in KINDS or _joined(w) for w in tokens) and any(w.rstrip(".") in KINDS or _joined(w) for w in others):
        tokens, others = others, tokens
    if not tokens:
        return None
    kind = name = None
    for i, w in enumerate(tokens):
        if found := _joined(w):
            name, kind = found
            tokens = tokens[:i] + tokens[i + 1 :]
            break
    bare = [w.rstrip(".") for w in tokens]
    if kind is None and len(bare) >= 2:
        exact = [(i, w) for i, w in enumerate(bare) if w in KINDS]
        trailing = [(i, w) for i, w in exact if i and not (exact[0][0] == 0 and w not in LEADING and bare[0] in LEADING)]
        known = ([exact[0]] if exact and exact[0] == (0, bare[0]) and bare[0] in LEADING else trailing[-1:]) or exact[:1] or [(i, k) for i, w in enumerate(bare[:3]) if (k := _kind(w))][:1]
        elsewhere = bool(loose or postcode or others)  # the town stands in another part
        if known:
            i, kind = known[0]
            if i == 0:
                end = 1
                while end < len(bare) - 1 and bare[end] in SMALL:
                    end += 1
                end = len(bare) if elsewhere else end + 1
                name, bare = "".join(bare[1:end]), bare[end:]
            else:
                begin = 0 if elsewhere or back else i - 1
                name, bare = "".join(bare[begin:i]), bare[:begin] + bare[i + 1 :]
        else:  # a short form stands for the kind: the first of up to three letters, else the shortest word
            i = next((i for i, w in enumerate(bare) if len(w) <= (3 if i or len(bare) == 2 else 2)), min(range(len(bare)), key=lambda i: len(bare[i])))
            kind = "?" + bare[i]
            name, bare = (bare[1], bare[2:]) if i == 0 else ("".join(bare[:i]), bare[i + 1 :])
    elif kind is None and bare:
        name, kind, bare = bare[0], "", []
    for i, w in enumerate(bare):  # German ends written apart
        if kind == "" and w in JOINED:
            kind = JOINED[w]
            bare = bare[:i] + bare[i + 1 :]
            break
    if not name or len(name) < 3:
        return None
    if bare:
        towns += [" ".join(bare)] + [" ".join(bare[:k]) for k in range(len(bare) - 1, 0, -1)] + [" ".join(bare[k:]) for k in range(1, len(bare))]
    if others:
        beyond = [w.rstrip(".") for w in others if len(w) > 2]
        towns += [" ".join(beyond[:k]) for k in range(len(beyond), 0, -1)] + [" ".join(beyond[k:]) for k in range(1, len(beyond))]
    towns += [re.sub(r"[^a-z ]+", " ", x).strip() for x in loose if not re.search(r"\d", x)]
    tidy = lambda x: re.sub(r"\s+", " ", re.sub(r"[^a-z]+", " ", x)).strip()
    towns = [t for t in dict.fromkeys(tidy(t) for t in towns) if len(t) > 2]
    return {"number": number + letter, "kind": kind, "name": name.replace("'", ""), "postcode": postcode, "beside": tidy(beside) if beside else None, "towns": towns}


_SCHEMA = "field string, id long, n long, number string, kind string, name string, postcode string, beside string, towns array<string>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("field", pa.string()), ("id", pa.int64()), ("n", pa.int64()), *((c, pa.string()) for c in ("number", "kind", "name", "postcode", "beside")), ("towns", pa.list_(pa.string()))])
    for b in batches:
        rows = [{"field": f, "id": i, "n": n} | r for f, i, n, s in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True) if (r := read(s))]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def mine_towns(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(text, town)``, ``(postcode, town)`` and ``(prefix, town)`` from addresses with both.

    A text becomes the town that most of its postcodes' addresses name, if the
    two stand on the same postcodes more often than chance allows, or if it is
    seen too seldom to tell and is within the typing errors of the town; round
    after round until no text changes, or a state comes again.
    """
    seen = written(rows.where("postcode is not null and beside is not null and beside <> ''").groupBy("postcode", F.col("beside").alias("text")).agg(F.count("*").alias("n")), "town-texts")
    total = written(seen.groupBy("text").agg(F.sum("n").alias("support")), "town-support")
    every, tests = (total.agg(F.coalesce(F.sum("support"), F.lit(0)), F.count("*")).first()[i] for i in (0, 1))
    least = CRITICAL + 2 * math.log(max(1, tests))
    current, states = total.select("text", F.col("text").alias("town")), set()
    while True:
        named = seen.join(current, "text").join(total.withColumnsRenamed({"text": "town", "support": "of_town"}), "town")
        by_code = named.groupBy("postcode", "town").agg(F.sum("n").alias("n"), F.max("of_town").alias("of_town"))
        mode_code = written(by_code.groupBy("postcode").agg(F.max_by("town", F.struct("n", "of_town", "town")).alias("leader"), F.sum("n").alias("addresses")), "town-leaders")
        there = mode_code.groupBy("leader").agg(F.sum("addresses").alias("there"))
        shift = seen.join(mode_code, "postcode").groupBy("text", "leader").agg(F.sum("n").alias("n"))
        best = shift.groupBy("text").agg(F.max_by("leader", F.struct("n", "leader")).alias("leader"), F.max("n").alias("n")).join(total, "text").where(F.col("n") >= LEAST_SHARE * F.col("support"))
        bigger = best.join(total.withColumnsRenamed({"text": "leader", "support": "of_leader"}), "leader").where("of_leader > support").join(there, "leader")
        ratio = F.expr(likelihood_ratio("n", "support", "there", f"{every}L"))
        told = written(bigger.select("text", "leader", ((F.col("n") >= LEAST_STREETS) & (ratio >= least)).alias("sure")), "town-shifts")
        alike = told.where("not sure").select("text", F.col("leader").alias("_front")).mapInArrow(_misspelt, "text string, _front string").withColumnRenamed("_front", "leader")
        kept = told.where("sure").select("text", "leader").unionByName(alike)
        renewed = written(total.select("text").join(kept, "text", "left").select("text", F.coalesce("leader", "text").alias("town")), "towns")
        state = renewed.agg(F.sum(F.xxhash64("text", "town").cast("decimal(38,0)"))).first()[0]
        current = renewed
        if state in states:
            break
        states.add(state)
    final = seen.join(current, "text")
    code = final.groupBy("postcode", "town").agg(F.sum("n").alias("n")).groupBy("postcode").agg(F.max_by("town", F.struct("n", "town")).alias("town"))
    front = final.groupBy(F.substring("postcode", 1, 3).alias("prefix"), "town").agg(F.sum("n").alias("n")).groupBy("prefix").agg(F.max_by("town", F.struct("n", "town")).alias("town"), F.max("n").alias("top"), F.sum("n").alias("all")).where("top >= 5 and top >= 0.9 * all").select("prefix", "town")
    return current, code, front


def _misspelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose ``text`` is within the typing errors allowed of ``_front``."""
    for b in batches:
        pairs_ = [(t.replace(" ", ""), f.replace(" ", "")) for t, f in zip(b.column("text").to_pylist(), b.column("_front").to_pylist(), strict=True)]
        yield b.filter(pa.array([distance(t, f, k := errors_allowed(min(len(t), len(f)))) <= k for t, f in pairs_], pa.bool_()))


def place(rows: DataFrame) -> DataFrame:
    """``rows`` with ``town``: by its postcode, else by its text, else by the front of the postcode or a text near a town's."""
    texts, codes, fronts = mine_towns(rows)
    tried = rows.select("field", "id", F.posexplode(F.array_distinct(F.concat(F.when(F.col("beside").isNotNull(), F.array("beside")).otherwise(F.array().cast("array<string>")), "towns"))).alias("at", "text"))
    hit = tried.join(texts, "text")
    by_code = rows.select("field", "id", "postcode").where("postcode is not null").join(codes, "postcode", "left").withColumn("prefix", F.substring("postcode", 1, 3)).join(fronts.withColumnRenamed("town", "_front"), "prefix", "left").select("field", "id", F.col("town").alias("by_code"), "_front")
    by_text = hit.groupBy("field", "id").agg(F.min_by("town", F.struct("at")).alias("by_text"))
    known = written(rows.join(by_code, ["field", "id"], "left").join(by_text, ["field", "id"], "left").withColumn("text", F.coalesce("by_code", "by_text")).drop("by_code", "by_text"), "addresses-decided")
    # a front may hold other towns than its greatest: that is only for addresses without a town, and for misspelt ones
    misspelt = known.where("text <> _front").select("text", "_front").distinct().mapInArrow(_misspelt, "text string, _front string").withColumn("_town", F.col("_front"))
    known = known.join(misspelt, ["text", "_front"], "left").withColumn("town", F.coalesce("_town", "text", "_front")).drop("text", "_front", "_town")
    known = written(known, "addresses-placed")
    lost = known.where("town is null").select(F.explode("towns").alias("text")).distinct().select(F.lit("town").alias("block"), F.xxhash64("text").alias("node"), F.array(F.replace("text", F.lit(" "), F.lit(""))).alias("forms"), F.lit(False).alias("indexed"), F.lit(True).alias("asking"), "text")
    sure = texts.where("text = town").select(F.lit("town").alias("block"), F.xxhash64(F.lit("known"), "town").alias("node"), F.array(F.replace("town", F.lit(" "), F.lit(""))).alias("forms"), F.lit(True).alias("indexed"), F.lit(False).alias("asking"), "town")
    close = near(sure.drop("town").unionByName(lost.drop("text"))).join(lost.select("node", "text"), "node").join(sure.select(F.col("node").alias("near"), "town"), "near")
    fuzzy = close.groupBy("text").agg(F.min_by("town", F.struct("distance", "town")).alias("town"))
    more = known.where("town is null").select("field", "id", F.posexplode("towns").alias("at", "text")).join(fuzzy, "text").groupBy("field", "id").agg(F.min_by("town", "at").alias("_near"))
    return known.join(more, ["field", "id"], "left").withColumn("town", F.coalesce("town", "_near")).drop("_near")


def mine_kinds(rows: DataFrame) -> DataFrame:
    """``(town, kind, better)``: street words that mean another, from addresses that agree in town, number and name.

    What is learnt of a word anywhere holds in every town that knows the better
    word, so that one short form can mean a street here and a Strasse there.
    """
    spots = written(rows.where("town is not null and kind <> ''").select("town", "number", "name", "kind").distinct(), "address-spots")
    sets = written(spots.groupBy("town", "number", "name").agg(F.collect_set("kind").alias("kinds")).where(F.size("kinds") > 1), "address-kinds")
    pair = sets.select("name", F.explode("kinds").alias("kind"), "kinds").select("name", "kind", F.explode("kinds").alias("better")).where("kind like '?%' and better not like '?%'")
    count = written(pair.groupBy("kind", "better").agg(F.countDistinct("name").alias("streets")), "kind-pairs")
    total = sets.select("name", F.explode("kinds").alias("kind")).groupBy("kind").agg(F.countDistinct("name").alias("all"))
    names_, tests = sets.agg(F.countDistinct("name")).first()[0], count.count()
    tested = count.join(total, "kind").join(total.withColumnsRenamed({"kind": "better", "all": "all_better"}), "better")
    ratio = F.expr(likelihood_ratio("streets", "all", "all_better", f"{names_}L"))
    # a word that stands nowhere but beside one other has nothing to be tested against
    sure = (ratio >= CRITICAL + 2 * math.log(max(1, tests))) | ((F.col("streets") == F.col("all")) & (F.col("all_better") == F.lit(names_)))
    kept = tested.where((F.col("streets") >= LEAST_STREETS) & (F.col("streets") >= LEAST_SHARE * F.col("all")) & sure)
    used = spots.groupBy("town", "kind").agg(F.count("*").alias("uses"))
    open_ = used.where("kind like '?%'").select("town", "kind").join(kept, "kind")
    there = used.select("town", F.col("kind").alias("better"), "uses").where("uses >= 2")
    return open_.join(there, ["town", "better"]).groupBy("town", "kind").agg(F.max_by("better", F.struct("streets", "uses", "better")).alias("better"))


def rewritten(rows: DataFrame) -> DataFrame:
    """``rows`` with street words rewritten until mining finds nothing new; what stays unknown is no kind.

    A round makes unknown words known ones, so it ends.
    """
    while True:
        rules = written(mine_kinds(rows), "rewrites")
        if not rules.limit(1).count():
            return rows
        rows = written(rows.join(rules, ["town", "kind"], "left").withColumn("kind", F.coalesce("better", "kind")).drop("better"), "rewritten")


def locations(rows: DataFrame) -> DataFrame:
    """``(field, id, entity)`` of read addresses with a town."""
    placed = rewritten(written(place(rows).where("town is not null"), "addresses"))
    block = F.concat_ws("|", "field", "town", "number", "kind")
    keyed = placed.withColumn("block", block).withColumn("node", F.xxhash64("block", "name"))
    nodes = written(keyed.groupBy("block", "node").agg(F.first("name").alias("name"), F.sum("n").alias("n"), F.first("field").alias("field"), F.first("town").alias("town"), F.first("number").alias("number"), F.first("kind").alias("kind")), "address-nodes")
    links = near(nodes.select("block", "node", F.array("name").alias("forms"), F.lit(True).alias("indexed"), F.lit(True).alias("asking")), mutual=True)
    found = written(nodes.join(roots(nodes, links), "node"), "address-roots")
    # a street without its kind, or with one that nothing explains, is the one street of that name at the number
    vague = F.col("kind").isin("") | F.col("kind").startswith("?")
    wide = F.concat_ws("|", "field", "town", "number")
    hubs = found.where(~vague & (F.col("node") == F.col("root")))
    asked = found.where(vague & (F.col("node") == F.col("root")))
    close = near(hubs.select(wide.alias("block"), "node", F.array("name").alias("forms"), F.lit(True).alias("indexed"), F.lit(False).alias("asking")).unionByName(asked.select(wide.alias("block"), "node", F.array("name").alias("forms"), F.lit(False).alias("indexed"), F.lit(True).alias("asking"))))
    least = close.withColumn("best", F.min("distance").over(Window.partitionBy("node"))).where("distance = best").groupBy("node").agg(F.count("*").alias("c"), F.first("near").alias("home")).where("c = 1").select(F.col("node").alias("root"), "home")
    entity = found.join(least, "root", "left").select("node", F.coalesce("home", "root").alias("entity"))
    return keyed.select("field", "id", "node").join(entity, "node").select("field", "id", "entity")


def same_addresses(invoices: DataFrame, receipts: DataFrame) -> DataFrame:
    """``(field, id_a, id_b)`` of spellings of one location in the three address columns.

    Null, empty and unreadable addresses, and those whose town cannot be told,
    have no location; repeated rows are one spelling.
    """
    seen = spellings([(invoices, ("vendor_address", "customer_address")), (receipts, ("merchant_address",))])
    rows = written(seen.mapInArrow(_read, _SCHEMA), "addresses-read")
    return pairs(written(locations(rows), "addresses-linked"))
