"""Rule and taxonomy lookups that assign areas to records."""

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.functions.text import fold, let, ordered_union, squeeze, strip_accents

MAX_AREAS = 3
MAX_RULES = 10_000
STATUTE = r"(?U)\b(\d{1,4})\s*/\s*(\d{4})\b"


class Rules:
    """A rule dimension (key, ord, areas) small enough to be part of the expression.

    The size is checked on loading; a dimension above ``MAX_RULES`` is refused here and goes
    through :func:`contains_join` / an equi-join instead.  Lookups are row-level: no shuffle.
    """

    def __init__(self, dim: DataFrame):
        rows = dim.select("key", "ord", "areas").limit(MAX_RULES + 1).collect()
        if len(rows) > MAX_RULES:
            raise ValueError("rule dimension too large for an expression; use contains_join")
        self.rules = sorted(((r["key"], r["ord"], list(r["areas"])) for r in rows), key=lambda r: r[1])

    @property
    def _empty(self) -> Column:
        return F.array().cast("array<string>")

    def _areas(self, areas: list[str]) -> Column:
        return F.array(*[F.lit(a) for a in areas]) if areas else self._empty

    def _map(self) -> Column:
        if not self.rules:
            return F.create_map().cast("map<string,array<string>>")
        unique = {squeeze_text(k): a for k, _, a in self.rules}
        return F.map_from_arrays(F.array(*[F.lit(k) for k in unique]),
                                 F.array(*[self._areas(a) for a in unique.values()]))

    def exact(self, value: Column) -> Column:
        """Areas of the value itself, else of the part before a spaced dash."""
        v, table = squeeze(value), self._map()
        head = F.element_at(F.split(v, r"\s+[-–]\s+"), 1)
        return F.slice(F.array_distinct(F.coalesce(
            F.try_element_at(table, v), F.try_element_at(table, head), self._empty)), 1, MAX_AREAS)

    def contained(self, texts: Column) -> Column:
        """Areas of every key that occurs inside any text, in rule order."""
        if not self.rules:
            return self._empty
        whole = F.lower(F.array_join(texts, "\u0000"))
        table = F.array(*[F.struct(F.lit(k.lower()).alias("key"), self._areas(a).alias("areas"))
                          for k, _, a in self.rules])
        hits = let(whole, lambda t: F.filter(table, lambda r: t.contains(r["key"])))
        return F.slice(F.array_distinct(F.flatten(F.transform(hits, lambda r: r["areas"]))), 1, MAX_AREAS)

    def statutes(self, texts: Column) -> Column:
        """Areas of the statutes cited in the texts, in order of citation."""
        table = self._map()
        found = F.transform(statute_numbers(texts), lambda n: F.coalesce(F.try_element_at(table, n), self._empty))
        return F.slice(F.array_distinct(F.flatten(found)), 1, MAX_AREAS)


def squeeze_text(s: str) -> str:
    return " ".join(s.split())


def statute_numbers(texts: Column) -> Column:
    """Distinct statute numbers (``121/2000``) cited in an array of texts, in order."""
    def cited(text: Column) -> Column:
        number = F.regexp_extract_all(text, F.lit(STATUTE), F.lit(1))
        year = F.regexp_extract_all(text, F.lit(STATUTE), F.lit(2))
        return F.zip_with(number, year, lambda n, y: F.concat(n.cast("int").cast("string"), F.lit("/"), y))

    # Text by text: a number at the end of one and a year in the next are no citation.
    each = F.array_compact(F.coalesce(texts, F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.transform(each, cited)))


#: Length of the pieces that texts are indexed by; a shorter key is a piece itself.
PIECE = 4


def contains_join(items: DataFrame, dim: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rule key) pairs where the text contains the rule key, for a dimension of any size.

    Texts are indexed by their pieces of ``PIECE`` characters, a row per place however long the rules
    are.  A rule is looked up by the one of its pieces that the fewest texts have, and a rule with a piece that no
    text has is dropped.  What remains is verified against the text.  ``key`` identifies an item.
    """
    rules = dim.select(F.lower("key").alias("rule")).where("rule <> ''").distinct()
    texts = items.select(key, F.lower(F.col(text)).alias("_t"))

    def pieces(of: Column, length: int) -> Column:
        # A look-ahead matches at every position, so one pass yields all pieces of that length.
        return F.regexp_extract_all(of, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))

    # At most PIECE numbers: how long the pieces are that the rules have.
    lengths = sorted(r[0] for r in rules.select(F.least(F.length("rule"), F.lit(PIECE))).distinct().collect())
    if not lengths:
        return texts.join(rules, F.lit(False)).select(key, "rule")
    probes = texts.select(key, F.explode(F.array_distinct(F.concat(*[pieces(F.col("_t"), n) for n in lengths]))).alias("piece"))
    common = probes.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("rule") < PIECE, F.array("rule")).otherwise(F.array_distinct(pieces(F.col("rule"), PIECE)))
    anchors = (rules.select("rule", own.alias("_own")).select("rule", F.size("_own").alias("all"), F.explode("_own").alias("piece"))
               .join(common, "piece").groupBy("rule", "all").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"), F.count(F.lit(1)).alias("found"))
               .where(F.col("found") == F.col("all")).select("rule", "piece"))
    # Spark guesses the size of texts and pieces from their files, far too low, and would send them all to the driver.
    return (probes.hint("merge").join(anchors, "piece").select(key, "rule").join(texts.hint("merge"), key)
            .where(F.contains("_t", "rule")).select(key, "rule"))


def schedule_related(text: Column) -> Column:
    """Whether a page of schedules names a matter that is followed."""
    return F.coalesce(text.rlike(SCHEDULE_KEYWORDS), F.lit(False))


class Taxonomy:
    """Area dimension with names and aliases, matched without accents and case."""

    def __init__(self, areas: DataFrame, aliases: DataFrame):
        rows = areas.select("id", "name").limit(MAX_RULES + 1).collect()
        old = aliases.select("old", "new").limit(MAX_RULES + 1).collect()
        if max(len(rows), len(old)) > MAX_RULES:
            raise ValueError("taxonomy too large for an expression; use area_join")
        self.pairs = [(t, r["id"]) for r in rows for t in (r["id"], r["name"])] + [(a["old"], a["new"]) for a in old]

    def area_of(self, token: Column) -> Column:
        keys = F.array(*[area_token(F.lit(t)) for t, _ in self.pairs])
        ids = F.array(*[F.lit(i) for _, i in self.pairs])
        # A later name or alias overrides an earlier one, hence the last match.
        hit = let(area_token(token), lambda wanted: F.array_max(F.transform(keys, lambda k, i: F.when(k == wanted, i))))
        return F.get(ids, hit)

    def normalise(self, tokens: Column) -> Column:
        ids = F.filter(F.transform(tokens, self.area_of), lambda i: i.isNotNull())
        return F.slice(F.array_distinct(ids), 1, MAX_AREAS)


def area_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(strip_accents(c))), r"(?U)[\s_\-]+", "_")


def area_join(tokens: DataFrame, aliases: DataFrame, key: str, token: str, pos: str) -> DataFrame:
    """Token table to ordered areas through an alias table of any size (``alias``, ``id``)."""
    dim = aliases.select(area_token(F.col("alias")).alias("_k"), F.col("id").alias("_id"))
    hits = tokens.withColumn("_k", area_token(F.col(token))).join(dim, "_k")
    firsts = hits.groupBy(key, F.col("_id").alias("area")).agg(F.min(pos).alias("ord"))
    return firsts


def relevance(senate: Column, parties: Column, register: Column, chair_key: Column, senates: list[str],
              party_pattern: str | None, judges: list[str]) -> Column:
    """Listed senate, or a listed party, or (in the chair-decided register) a listed judge."""
    text = squeeze(fold(F.array_join(F.coalesce(parties, F.array().cast("array<string>")), " | ")))
    by_party = text.rlike(party_pattern) if party_pattern else F.lit(False)
    return (F.lower(senate).isin(*[s.lower() for s in senates]) | by_party
            | ((register == "Nc") & chair_key.isin(*judges)))


# Outcomes that mean a procedural decision, per court.
ADMIN_PROCEDURAL = ("odmítnuto", "zastaveno", "řízení:", "odkladný účinek", "nepodjatý", "podjatý")
CONSTITUTIONAL_PROCEDURAL = (
    "odmítnuto pro neodstraněné vady", "odmítnuto pro nepřípustnost", "odmítnuto pro nepříslušnost",
    "odmítnuto pro opožděnost", "odmítnuto pro nedodržení lhůty", "odmítnuto pro neoprávněnost",
    "odmítnuto - pro", "zastaveno", "procesní")
ADMIN_PANELS = ("kárný senát", "zvláštní senát podle z. č. 131/2002 Sb.")
OBVIOUS_PARTY = r"(?U)\b(EUIPO|OHIM|CPVO)\b"
SCHEDULE_KEYWORDS = (r"(?iuU)duševn|dusevn|autorsk|průmyslov|prumyslov|nekal\w{0,3}\s+sout|kolektivn\w+\s+správc"
                     r"|kolektivn\w+\s+spravc|osobních údajů|osobnich udaju")
CONSTITUTIONAL_STATUTES = ("1/1993", "2/1993", "209/1992", "182/1993")
QUESTION_TITLE = r"(?iuU)předběžn\w* otáz|preliminary ruling"
WORK_KINDS = {"JUDG": "rozsudek", "ORDER": "usnesení", "OPIN_AG": "stanovisko GA", "VIEW_AG": "stanovisko GA"}


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.lit(False)
    for p in prefixes:
        out = out | t.startswith(p)
    return out


def any_outcome_procedural(outcome: Column, prefixes: tuple[str, ...] = ADMIN_PROCEDURAL) -> Column:
    return starts_with_any(outcome, prefixes)


def all_outcomes_procedural(outcomes: Column, prefixes: tuple[str, ...] = CONSTITUTIONAL_PROCEDURAL) -> Column:
    given = F.filter(outcomes, lambda o: F.trim(o) != "")
    return (F.size(given) > 0) & F.forall(given, lambda o: starts_with_any(o, prefixes))


def panel_allowed(panel: Column, marker: str = "NSS", listed: tuple[str, ...] = ADMIN_PANELS) -> Column:
    p = squeeze(panel)
    return F.array_contains(F.split(p, " "), marker) | p.isin(*listed)


def work_kind(type_uri: Column) -> Column:
    """Kind of decision from the last segment of its type address; NULL for types that are not kept."""
    table = F.create_map(*[F.lit(x) for kv in WORK_KINDS.items() for x in kv])
    return F.try_element_at(table, F.substring_index(type_uri, "/", -1))


def compose_areas(*hits: Column) -> Column:
    """Areas of several rules in priority order."""
    return ordered_union(*hits, limit=MAX_AREAS)


def constitutional_areas(mark: Column, statutes: Column, register_terms: Column, statute_rules: Rules,
                         term_rules: Rules, plenum_area: str = "ustavni") -> Column:
    """Plenary cases add their area; constitutional statutes say nothing about the matter."""
    telling = F.filter(statutes, lambda s: ~starts_with_any(s, CONSTITUTIONAL_STATUTES))
    plenary = F.when(mark.startswith("Pl."), F.array(F.lit(plenum_area))).otherwise(F.array().cast("array<string>"))
    return compose_areas(plenary, statute_rules.statutes(telling), term_rules.contained(register_terms))
