"""Spellings of one organisation or person (problem 3).

Each distinct spelling is cut into words; forms of law, branch notes, titles and
place-holders are taken off.  What says a line of trade and what a given name is
learnt from the spellings themselves (:func:`vocabulary`): runs of words that
stand beside many different other words, and the short forms, nicknames and
abbreviations that take their place beside the same other words more often than
chance allows.  House names and surnames go through a trie join within the same
trade or given name, in every order of their words; each links to the most used
spelling near it.  Spellings that leave the trade or the given name out join the
one entity that fits them; those that fit none are joined among themselves, with
their words matched one by one.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.tries import errors_allowed, near
from ledgerloom.session import bounded, written

#: A run is a trade or a given name if the other words beside it are worth so many equally frequent ones, and so large a share of the most any run has.
LEAST_PARTNERS, PARTNER_SHARE = 10.0, 0.05
#: Of a trade, so large a share of the spellings has a form of law; given names have none.
LAWFUL_SHARE = 0.3
#: A run means another if they share so many surroundings, so large a share of its own, and a log-likelihood ratio of 10.83 (one in a thousand by chance) for a single test.
LEAST_SURROUNDINGS, LEAST_SHARE, CRITICAL = 3, 0.1, 10.83
#: Entries that stand for no name.
PLACEHOLDERS = {"", "n a", "na", "none", "unknown", "walk in", "walkin", "store", "customer", "cash customer", "guest", "various", "tbd", "tbc", "see above", "null", "nil", "misc", "anonymous", "x", "test", "not available", "merchant", "vendor", "shop"}
#: Forms of law, as written without dots.
LEGAL = {
    "ltd": "ltd", "limited": "ltd", "gmbh": "gmbh", "mbh": "gmbh", "gesellschaft mbh": "gmbh", "ag": "ag", "aktiengesellschaft": "ag", "llc": "llc", "inc": "inc", "incorporated": "inc", "corp": "inc", "corporation": "inc", "bv": "bv", "sarl": "sarl",
    "sa": "sa", "plc": "plc", "kg": "kg", "& co": "co", "+ co": "co", "and co": "co", "& company": "co", "and company": "co", "+ company": "co", "co": "co", "company": "co", "und co": "co", "et cie": "co", "& cie": "co",
}
#: Words before a firm's name, and before a person's.
OPENINGS = ("firma", "fa", "the", "messrs", "m s", "die", "la", "le")
TITLES = {"mr", "mrs", "ms", "mx", "miss", "dr", "prof", "hon", "herr", "frau", "mme", "mlle", "sir", "rev"}
JOINING = {"&", "+", "and", "und", "et"}


_MISREAD = [(d, x, re.compile(rf"(?<=[a-z]){d}(?![\d])|(?<!\d){d}(?=[a-z])")) for d, x in (("0", "o"), ("1", "l"), ("5", "s"))]


def plain(text: str) -> str:
    """Lower case without accents, letters read as digits put right."""
    s = text.casefold()
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s.replace("ø", "o").replace("ł", "l").replace("đ", "d"))
        s = "".join(c for c in s if not unicodedata.combining(c))
    for digit, letter, pattern in _MISREAD:
        if digit in s:
            s = pattern.sub(letter, s)
    return s.replace("rn", "m")


def distance(a: str, b: str, k: int) -> int:
    """Edit distance with exchanges, ``k + 1`` if above ``k``."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    before, row = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, t in enumerate(b, 1):
            d = row[j - 1] if c == t else 1 + min(row[j - 1], row[j], new[-1])
            if before and j > 1 and a[i - 2] == t and b[j - 2] == c:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
        if min(row) > k:
            return k + 1
    return row[-1]


_LEGAL = {plain(w): v for w, v in LEGAL.items()}


def _without(tokens: list[str], known: dict) -> tuple[str | None, list[str]]:
    """The value of the longest last run of words that is known, and the other words."""
    for size in (3, 2, 1):
        for at in range(len(tokens) - size, -1, -1):
            if (run := " ".join(tokens[at : at + size])) in known:
                return known[run], tokens[:at] + tokens[at + size :]
    return None, tokens


def read(spelling: str) -> dict | None:
    """Words, form of law, number of words before a comma, and whether the page's edge may have cut the end; null for a place-holder."""
    cut = len(spelling) >= 20 and spelling == spelling.upper()
    s = re.sub(r"\s*(?:\*|#\s*\d+|\(head office\)|-\s*accounts dept\.?|,?\s*branch\s+\d+|\(hq\))\s*$", "", spelling.strip(), flags=re.I)
    low = plain(re.sub(r"(?<=[a-zà-ÿ]{3})(?=[A-ZÀ-Þ][a-zà-ÿ]{2})", " ", s) if not s.isupper() else s)
    low = re.sub(r"\b(?:[a-z]\.){2,}", lambda m: m[0].replace(".", "") + " ", low)
    low = re.sub(r"\bm/s\b", "", low)
    low = re.sub(r"[^\w&+,]+", " ", low.replace("_", " ")).strip()
    if low.replace(",", " ").strip() in PLACEHOLDERS or low.startswith(("see ", "siehe ", "voir ")) or not re.search(r"[a-z]{2}", low):
        return None
    tokens = low.replace(",", " ").split()
    while len(tokens) > 1 and tokens[0] in OPENINGS:
        tokens = tokens[1:]
    legal, rest = _without(tokens, _LEGAL)
    if legal is None and cut and len(tokens) > 2 and len(spelling) >= 22 and len(tokens[-1]) <= 2:
        rest = tokens[:-1]
    while len(rest) > 1 and rest[0] in OPENINGS:
        rest = rest[1:]
    rest = [w for w in rest if w not in JOINING and (legal or w not in TITLES)]
    first = low.split(",")[0].split() if "," in low else []
    return {"tokens": rest, "words": [w for w in rest if len(w) > 1], "legal": legal or "", "first": [w for w in first if w in rest], "cut": cut}


def _take(tokens: list[str], run: list[str], last: bool) -> list[str]:
    places = range(len(tokens) - len(run), -1, -1) if last else range(len(tokens) - len(run) + 1)
    at = next(i for i in places if tokens[i : i + len(run)] == run)
    return tokens[:at] + tokens[at + len(run) :]


def told(words: dict, hit: dict | None) -> dict | None:
    """Kind, name (forms), detail (trade or given names) of a read spelling, ``hit`` being what the vocabulary knows of it."""
    tokens, legal = words["tokens"], words["legal"]
    trade = hit is not None and hit["role"] == "trade"
    if trade or legal:
        house = _take(tokens, hit["run"].split(), True) if trade else tokens
        if words["cut"] and len(house) > 2 and len(house[-1]) <= 3:
            house = house[:-1]
        if not house:
            return None
        forms = ["".join(house)] + (["".join(p) for p in itertools.permutations(house)] if len(house) <= 3 else [])
        return {"kind": "org", "name": forms[0], "forms": sorted(set(forms), key=forms.index), "words": house, "detail": sorted(hit["values"]) if trade else [], "initial": "", "legal": legal}
    rest = [w for w in _take(tokens, hit["run"].split(), False)] if hit else tokens
    initials, surname = [w for w in rest if len(w) == 1], [w for w in rest if len(w) > 1]
    if not surname:
        return None
    name = "".join(surname)
    if not hit and not initials and len(surname) > 1:
        forms = ["".join(p) for p in itertools.permutations(surname)] if len(surname) <= 3 else []
        return {"kind": "org", "name": name, "forms": [name, *(f for f in forms if f != name)], "words": surname, "detail": [], "initial": "", "legal": ""}
    return {"kind": "person", "name": name, "forms": [name], "words": surname, "detail": sorted(hit["values"]) if hit else [], "initial": "" if hit else (initials or [""])[0], "legal": ""}


_WORDS = "field string, id long, n long, tokens array<string>, words array<string>, legal string, first array<string>, cut boolean"
_READ = T.StructType().add("field", "string").add("id", "long").add("n", "long").add("kind", "string").add("name", "string").add("forms", T.ArrayType(T.StringType())).add("words", T.ArrayType(T.StringType())).add("detail", T.ArrayType(T.StringType())).add("initial", "string").add("legal", "string")
_LIST = pa.list_(pa.string())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("field", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("tokens", _LIST), ("words", _LIST), ("legal", pa.string()), ("first", _LIST), ("cut", pa.bool_())])
    for b in batches:
        rows = [{"field": f, "id": i, "n": n} | r for f, i, n, s in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True) if (r := read(s))]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("field", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("forms", _LIST), ("words", _LIST), ("detail", _LIST), ("initial", pa.string()), ("legal", pa.string())])
    for b in batches:
        rows = [{"field": x["field"], "id": x["id"], "n": x["n"]} | r for x in b.to_pylist() if (r := told(x, x["hit"]))]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def runs(words: DataFrame, most: int = 2) -> DataFrame:
    """``words`` with a row for each run of up to ``most`` of its words: ``run``, ``at``, ``size`` and the other words as ``rest``."""
    places = F.expr(f"flatten(transform(sequence(1, {most}), k -> transform(filter(sequence(0, size(words) - 1), i -> i + k <= size(words)), i -> struct(i as at, k as size))))")
    out = words.where(F.size("words") > 0).withColumn("_p", F.explode(places))
    run = F.array_join(F.expr("slice(words, _p.at + 1, _p.size)"), " ")
    return out.select("*", run.alias("run"), F.col("_p.at").alias("at"), F.col("_p.size").alias("size"), F.expr("filter(words, (w, i) -> i < _p.at or i >= _p.at + _p.size)").alias("rest")).drop("_p")


def likelihood_ratio(both: str, first: str, second: str, all_: str) -> str:
    """SQL of the log-likelihood ratio of a two by two table, from the counts of both, of either, and of all; 0 where both are no more than chance gives."""
    cell = lambda o, r, c: f"CASE WHEN {o} > 0 THEN ({o}) * ln(({o}) * ({all_}) / (cast({r} AS double) * ({c}))) ELSE 0D END"
    ratio = " + ".join((cell(f"({both})", f"({first})", f"({second})"), cell(f"({first} - {both})", f"({first})", f"({all_} - {second})"), cell(f"({second} - {both})", f"({all_} - {first})", f"({second})"), cell(f"({all_} - {first} - {second} + {both})", f"({all_} - {first})", f"({all_} - {second})")))
    return f"CASE WHEN cast({both} AS double) * ({all_}) > cast({first} AS double) * ({second}) THEN 2 * ({ratio}) ELSE 0D END"


def vocabulary(words: DataFrame) -> DataFrame:
    """``(run, role, values, full)`` of runs of one or two words that say a trade or a given name, learnt from ``words``.

    How many partners a run has is counted as the inverse of Simpson's index of
    the words beside it, which a much used entity with many misspellings does not
    raise.  ``values`` are the full forms it stands for, itself where ``full``.
    A short form may stand for several; each is tested against chance, corrected
    for the number of tests.
    """
    every = runs(words.select("field", "legal", "words").distinct())
    slots = written(every.where(F.size("rest") > 0).select(F.xxhash64("field", "legal", F.array_sort("rest")).alias("key"), "run", F.xxhash64("run").alias("hash"), (F.col("legal") != "").alias("lawful"), F.transform("rest", lambda w: F.xxhash64(w)).alias("others")), "name-slots")
    beside = slots.select("hash", F.explode("others").alias("w")).groupBy("hash", "w").agg(F.count("*").alias("c"))
    partners = beside.groupBy("hash").agg((F.pow(F.sum("c"), F.lit(2.0)) / F.sum(F.col("c") * F.col("c"))).alias("partners"))
    used = slots.groupBy("run", "hash").agg(F.count("*").alias("uses"), F.avg(F.col("lawful").cast("double")).alias("lawful"))
    stats = written(partners.join(used, "hash").drop("hash").where("uses >= 3 or partners >= 3"), "name-runs")
    most = stats.agg(F.max("partners")).first()[0] or 0.0
    full = written(stats.where(F.col("partners") >= max(LEAST_PARTNERS, PARTNER_SHARE * most)).select("run", "uses", F.when(F.col("lawful") >= LAWFUL_SHARE, "trade").otherwise("given").alias("role")), "name-full")
    places = written(slots.select("key", "run").distinct(), "name-places")
    held = places.groupBy("run").agg(F.count("*").alias("n"))
    total = places.select("key").distinct().count()
    known = written(held.join(bounded(full), "run").select(F.col("run").alias("value"), F.col("n").alias("m"), F.col("uses").alias("v_uses"), "role"), "name-known")
    there = places.join(bounded(full.select("run")), "run").select("key", F.col("run").alias("value"))
    frequent = stats.where(F.col("uses") >= LEAST_SURROUNDINGS).select("run", "uses")
    both = places.join(there, "key").where("run <> value").groupBy("run", "value").agg(F.count("*").alias("c"))
    tested = written(both.join(held, "run").join(frequent, "run").join(bounded(known), "value").where("uses < v_uses"), "name-pairs")
    least = F.lit(CRITICAL) + 2 * F.log(F.lit(float(max(1, tested.count()))))
    meant = tested.where((F.col("c") >= LEAST_SURROUNDINGS) & (F.col("c") >= LEAST_SHARE * F.col("n")) & (F.expr(likelihood_ratio("c", "n", "m", f"{total}L")) >= least))
    short = meant.where(F.length("run") > 1).groupBy("run").agg(F.max_by("role", "c").alias("role"), F.array_sort(F.collect_set("value")).alias("values"))
    itself = full.join(short.select("run"), "run", "left_anti").select("run", "role", F.array("run").alias("values"), F.lit(True).alias("full"))
    return written(short.select("run", "role", "values", F.lit(False).alias("full")).unionByName(itself), "name-vocabulary")


def understood(words: DataFrame, known: DataFrame) -> DataFrame:
    """``(field, id, n, kind, name, forms, words, detail, initial, legal)`` of read spellings, by what ``known`` says of their runs.

    A run that is known decides; where there is none, a last word that a page's
    edge may have cut decides if one meaning begins with it, or a run within the
    typing errors allowed of a full form.  Of several, trades come before given
    names, long runs before short ones, for trades the last and for given names
    the first, those behind a comma before those in front.
    """
    cells = written(runs(words).select("field", "id", "run", "at", "size", (F.col("cut") & (F.col("at") + F.col("size") == F.size("words"))).alias("last"), F.array_contains("first", F.col("run")).alias("front")), "name-cells")
    best = lambda df: df.groupBy("field", "id").agg(F.min_by(F.struct("run", "role", "values"), F.struct(F.when(F.col("role") == "trade", 0).otherwise(1), F.when(F.col("role") == "trade", -F.col("size")).otherwise(0), F.col("front"), F.when(F.col("role") == "trade", -F.col("at")).otherwise(F.col("at")))).alias("hit"))
    exact = written(best(cells.join(bounded(known), "run")), "name-hits")
    open_ = written(cells.join(exact, ["field", "id"], "left_anti"), "name-open-cells")
    # beginnings that are those of one meaning alone
    begun = known.withColumn("begun", F.explode(F.expr("transform(sequence(2, greatest(length(run) - 1, 2)), k -> substring(run, 1, k))"))).groupBy("begun").agg(F.count_distinct("values").alias("c"), F.first("values").alias("values"), F.first("role").alias("role")).where("c = 1").select(F.col("begun").alias("run"), "values", "role")
    joined = F.replace("run", F.lit(" "), F.lit(""))
    node = lambda side: F.xxhash64(F.lit(side), "run")
    asked = open_.select("run").distinct().where("length(run) > 4")
    full = known.where("full and length(run) > 4")
    close = near(full.select(F.lit("").alias("block"), node("full").alias("node"), F.array(joined).alias("forms"), F.lit(True).alias("indexed"), F.lit(False).alias("asking")).unionByName(asked.select(F.lit("").alias("block"), node("asked").alias("node"), F.array(joined).alias("forms"), F.lit(False).alias("indexed"), F.lit(True).alias("asking"))))
    nearest = close.join(asked.withColumn("node", node("asked")), "node").join(bounded(full.select(node("full").alias("near"), "role", "values")), "near").groupBy("run").agg(F.min_by(F.struct("role", "values"), F.struct("distance", "near")).alias("m")).select("run", "m.role", "m.values")
    guessed = best(open_.where("last").join(bounded(begun), "run").unionByName(open_.where("not front").join(nearest, "run")))
    hits = exact.unionByName(guessed)
    return words.join(hits, ["field", "id"], "left").select("field", "id", "n", "tokens", "legal", "cut", "hit").mapInArrow(_told, _READ)


def spellings(records: list[tuple[DataFrame, tuple[str, ...]]], key: str = "record_id") -> DataFrame:
    """``(field, id, n, spelling)`` of every distinct value, stood for by its smallest key."""
    parts = [df.select(F.lit(f).alias("field"), F.col(key).cast("long").alias("id"), F.col(f).cast("string").alias("spelling")) for df, fields in records for f in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("spelling").isNotNull()).groupBy("field", "spelling").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("field", "id", "n", "spelling")


def roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, root)``: every node's most used neighbour, followed to its end.

    ``nodes(node, n)``, ``links(node, near, distance)``.  A link leads from the
    less to the more used node, ties to the smaller number, so chains end; they
    are followed by doubling until no node's root changes, which takes as many
    rounds as the logarithm of the longest chain.
    """
    known = nodes.select("node", "n")
    better = links.join(known, "node").join(known.withColumnsRenamed({"node": "near", "n": "m"}), "near").where("m > n or (m = n and near < node)")
    step = better.groupBy("node").agg(F.min_by("near", F.struct(F.col("distance"), -F.col("m"), F.col("near"))).alias("root"))
    out = written(known.select("node").join(step, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    while True:
        # only the nodes that are no root themselves are looked up again
        moving = out.where("node <> root")
        jumped = written(moving.join(moving.select(F.col("node").alias("root"), F.col("root").alias("_next")), "root", "left").select("node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots-moved")
        out = out.where("node = root").unionByName(jumped.select("node", "root"))
        if not jumped.where("moved").limit(1).count():
            return out


def any_order(nodes: DataFrame) -> DataFrame:
    """``nodes(block, node, forms, words, indexed, asking)`` as ``near`` takes them, names of four words or more in any order.

    As at most two errors are allowed, all words but two are unchanged: for each
    choice of two, the others go to the block in order of the alphabet, and the
    two, in both orders, are the forms.
    """
    flat = ("block", "node", "forms", "indexed", "asking")
    two = F.expr("flatten(transform(sequence(0, size(words) - 2), i -> transform(sequence(i + 1, size(words) - 1), j -> struct(array_join(array_sort(filter(words, (w, k) -> k <> i and k <> j)), ' ') as rest, words[i] as a, words[j] as b))))")
    more = nodes.where(F.size("words") > 3).select("block", "node", F.explode(two).alias("two"), "indexed", "asking")
    return nodes.select(*flat).unionByName(more.select(F.concat_ws("|", "block", F.lit("rest"), "two.rest").alias("block"), "node", F.array(F.concat("two.a", "two.b"), F.concat("two.b", "two.a")).alias("forms"), "indexed", "asking"))


def same_words(a: list[str], b: list[str]) -> bool:
    """Whether the words of two names are the same in some order, each within its own bound of errors and all within that of the name."""
    if len(a) != len(b):
        return "".join(a) == "".join(b)
    left, others = list(a), []
    for w in b:
        if w in left:
            left.remove(w)
        else:
            others.append(w)
    if len(left) > 2:  # each differs by an error at least
        return False
    most = errors_allowed(min(len("".join(a)), len("".join(b))))
    for order in itertools.permutations(others):
        each = [(distance(v, w, 2), errors_allowed(min(len(v), len(w)))) for v, w in zip(left, order, strict=True)]
        if all(d <= k for d, k in each) and sum(d for d, _ in each) <= most:
            return True
    return False


def _same_words(batches: Iterator[pa.RecordBatch], spaced: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows whose words are the same; where not ``spaced``, also those near in the order they are written, wherever words end."""
    for b in batches:
        keep = []
        for v, w in zip(b.column("words").to_pylist(), b.column("_words").to_pylist(), strict=True):
            x, y = "".join(v), "".join(w)
            k = errors_allowed(min(len(x), len(y)))
            keep.append(same_words(v, w) or (not spaced and distance(x, y, k) <= k))
        yield b.select(["node", "near", "distance"]).filter(pa.array(keep, pa.bool_()))


def among(open_: DataFrame) -> DataFrame:
    """``(node, root)`` of spellings that fit no entity of a listed trade or given name, linked among themselves.

    Firms of different forms of law stay apart; one written without its form
    joins those of its name if they have one form.
    """
    links = near(any_order(open_.select(F.concat_ws("|", "field", "kind", F.concat_ws(",", "detail"), "initial").alias("block"), "node", "forms", "words", F.lit(True).alias("indexed"), F.lit(True).alias("asking"))), mutual=True)
    words = open_.select("node", "words", "legal")
    both = links.join(words, "node").join(words.withColumnsRenamed({"node": "near", "words": "_words", "legal": "_legal"}), "near")
    checked = both.where("legal = _legal or legal = ''").select("node", "near", "distance", "words", "_words").mapInArrow(_same_words, "node long, near long, distance int")
    laws = open_.select("node", "legal")
    checked = written(checked.join(laws, "node").join(laws.withColumnsRenamed({"node": "near", "legal": "_legal"}), "near"), "open-links")
    own = written(roots(open_.select("node", "n"), checked.where("legal = _legal").select("node", "near", "distance")), "open-roots")
    lawful = checked.where("legal = '' and _legal <> ''").join(own, "node").join(own.withColumnsRenamed({"node": "near", "root": "_home"}), "near")
    sole = lawful.groupBy("root").agg(F.countDistinct("_legal").alias("laws"), F.min_by("_home", F.struct("distance", "_home")).alias("_home")).where("laws = 1").select("root", "_home")
    return own.join(sole, "root", "left").select("node", F.coalesce("_home", "root").alias("root"))


def link(read_: DataFrame) -> DataFrame:
    """``(field, id, entity)`` of the read spellings that are linked or alone in an entity."""
    full = F.size("detail") == 1
    block = F.concat_ws("|", "field", "kind", F.col("detail")[0])
    exact = read_.where(full).groupBy(block.alias("block"), "field", "kind", F.col("detail")[0].alias("detail"), "name").agg(F.min_by("forms", "id").alias("forms"), F.min_by("words", "id").alias("words"), F.sum("n").alias("n"), F.max("legal").alias("legal"), F.array_remove(F.collect_set("legal"), "").alias("laws"))
    nodes = written(exact.withColumn("node", F.xxhash64("block", "name")), "name-nodes")
    links = near(any_order(nodes.select("block", "node", "forms", "words", F.lit(True).alias("indexed"), F.lit(True).alias("asking"))), mutual=True)
    # near names of firms of different forms of law are different firms
    law = nodes.select("node", "laws", "words")
    lawful = links.join(law, "node").join(law.withColumnsRenamed({"node": "near", "laws": "_laws", "words": "_words"}), "near").where((F.size("laws") == 0) | (F.size("_laws") == 0) | F.arrays_overlap("laws", "_laws") | (F.col("distance") == 0))
    links = lawful.select("node", "near", "distance", "words", "_words").mapInArrow(lambda it: _same_words(it, False), "node long, near long, distance int")
    entity = written(nodes.select("node", "field", "kind", "detail", "name", "forms", "words", "legal", "n").join(roots(nodes, links), "node"), "name-roots")
    direct = read_.where(full).join(entity.select("field", "kind", F.col("detail").alias("_d"), "name", "root"), (entity["field"] == read_["field"]) & (entity["kind"] == read_["kind"]) & (F.col("_d") == F.col("detail")[0]) & (entity["name"] == read_["name"])).select(read_["field"], "id", F.col("root").alias("entity"))
    # spellings without trade or given name, or with one of several
    open_ = read_.where(~full).withColumn("node", F.xxhash64(F.lit("open"), "field", "kind", "name", F.col("detail").cast("string"), "initial", "legal"))
    asked = written(open_.groupBy("node").agg(*(F.min_by(c, "id").alias(c) for c in ("field", "kind", "name", "forms", "words", "detail", "initial", "legal")), F.sum("n").alias("n")), "names-open")
    wide = F.concat_ws("|", "field", "kind")
    hubs = entity.where("node = root").select(wide.alias("block"), "node", "forms", "words", F.lit(True).alias("indexed"), F.lit(False).alias("asking"))
    found = near(any_order(hubs.unionByName(asked.select(wide.alias("block"), "node", "forms", "words", F.lit(False).alias("indexed"), F.lit(True).alias("asking")))))
    home = entity.where("node = root").groupBy("node").agg(F.first("detail").alias("_detail"))
    law = entity.groupBy("root").agg(F.collect_set("legal").alias("_laws")).withColumnRenamed("root", "node")
    fits = written(
        found.join(asked, "node").join(home.join(law, "node").withColumnRenamed("node", "near"), "near")
        .where((F.col("kind") == "org") | F.array_contains("detail", F.col("_detail")) | ((F.size("detail") == 0) & ((F.col("initial") == "") | F.col("_detail").startswith(F.col("initial")))))
        .withColumn("rank", F.struct(F.when((F.col("legal") != "") & F.array_contains("_laws", F.col("legal")), 0).when(F.col("legal") == "", 1).otherwise(2), F.col("distance")))
        .select("node", "near", "rank"), "names-fits",
    )
    # the best rank must be reached by one entity alone
    best = fits.groupBy("node").agg(F.min("rank").alias("best"))
    sole = fits.join(best, "node").where("rank = best").groupBy("node").agg(F.count("*").alias("c"), F.first("near").alias("entity")).where("c = 1").select("node", "entity")
    alone = asked.join(sole, "node", "left")
    # what fits several entities is one with those that are written alike, what fits none also with those near it
    free = among(asked.join(fits.select("node").distinct(), "node", "left_anti"))
    rest = alone.join(free, "node", "left").select("node", F.coalesce("entity", "root", "node").alias("entity"))
    return direct.unionByName(open_.select("field", "id", "node").join(rest, "node").select("field", "id", "entity"))


def pairs(linked: DataFrame) -> DataFrame:
    """``(field, id_a, id_b)`` of all spellings of one entity."""
    a, b = linked.select("field", "entity", F.col("id").alias("id_a")), linked.select("field", "entity", F.col("id").alias("id_b"))
    return a.join(b, ["field", "entity"]).where("id_a < id_b").select("field", "id_a", "id_b").distinct()


def name_words(invoices: DataFrame, receipts: DataFrame) -> DataFrame:
    """The distinct names of the three fields in words, written."""
    seen = spellings([(invoices, ("vendor_name", "customer_name")), (receipts, ("merchant_name",))])
    return written(seen.mapInArrow(_read, _WORDS), "name-words")


def membership(invoices: DataFrame, receipts: DataFrame) -> DataFrame:
    """``(field, id, entity)``: the entity of every spelling that has one."""
    words = name_words(invoices, receipts)
    return written(link(written(understood(words, vocabulary(words)), "names-read")), "names-linked")


def same_names(invoices: DataFrame, receipts: DataFrame) -> DataFrame:
    """Pairs of spellings of one entity in vendor_name, customer_name and merchant_name.

    Null, empty and place-holder names have no entity; repeated rows are one
    spelling; a table without rows gives no pairs.
    """
    return pairs(membership(invoices, receipts))
