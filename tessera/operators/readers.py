"""Readers of page text: entries under headings with labelled fields and stat rows.

A line has ``doc, page, col, line_no, size`` (its largest letters), ``text`` and, for readers that need it, ``font``. A ``Reader`` says what a name looks like, what
labels and stat rows follow it and what makes it an entry. All rules are window expressions over the lines of a column, or of a page (``whole_page``), which are few;
a section heading holds for all that follows it in its document, over columns and pages.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import dehyphenate, stripped


@dataclass(frozen=True)
class Reader:
    """The rules of one kind of entry. Patterns are searched for, so they begin with ^ where the whole line counts."""

    #: Least and largest size of a name, as multiples of the page's most frequent size if ``relative``.
    size: tuple[float, float]
    relative: bool = False
    most_words: int = 5
    #: Names in lower case that are none, a pattern that no name has, and, if there are any, the only names.
    stop: tuple[str, ...] = ()
    refused: str | None = None
    only: tuple[str, ...] = ()
    #: A name is set in another font than most of the page, and only lines in that font are text.
    display: bool = False
    whole_page: bool = False
    #: Headings of at least that size, by pattern, and the section they open.
    sections: Mapping[str, str] = field(default_factory=dict)
    section_size: float = 0.0
    first_section: str | None = None
    #: Field to pattern with the value as its group; of several that match the first counts. ``last_wins``: else a repeated label is text.
    labels: Mapping[str, str] = field(default_factory=dict)
    last_wins: bool = False
    #: A line may have several labels, and the last value of each counts.
    several: bool = False
    #: What becomes of the lines after a label: 'lower' (those that begin in lower case continue it, up to one that doesn't), 'open' (all do), 'drop', or 'text'.
    after: Mapping[str, str] = field(default_factory=dict)
    after_all: str = "text"
    #: Fields that are put together if their label is repeated.
    joined: tuple[str, ...] = ()
    #: A header; the line behind it has the values: a pattern with a group for each of ``value_fields``.
    header: str | None = None
    values: str | None = None
    value_fields: tuple[str, ...] = ()
    #: Or values for the keys of ``attributes``, found by ``token``; ``optional`` is only there if the header has ``optional_mark`` or the count tells. ``bare``: a line of
    #: values that needs no header.
    attributes: tuple[str, ...] = ()
    token: str = r"\d+(?:\.\d+)?"
    optional: str | None = None
    optional_mark: str | None = None
    bare: str | None = None
    #: Of each group one field must be there ('attributes', 'text' too); least letters of a description.
    needed: tuple[tuple[str, ...], ...] = ()
    least: int = 30
    #: Entries with these names in lower case, or a name of this pattern, are left out when they are read.
    unwanted: tuple[str, ...] = ()
    unwanted_pattern: str | None = None
    #: A pattern taken off names; only the first entry of a name, in any case, is kept.
    trimmed: str | None = None
    once: bool = False


def body_sizes(lines: DataFrame) -> DataFrame:
    """``doc, page, body, body_font``: the most frequent size, to a tenth, and font of each page, by words; ties: the larger size."""
    font = F.col("font") if "font" in lines.columns else F.lit(None).cast("string")
    words = lines.select("doc", "page", F.round("size", 1).alias("s"), font.alias("f"), F.size(F.split(F.trim("text"), r"\s+")).alias("n"))
    per = words.groupBy("doc", "page", "s", "f").agg(F.sum("n").alias("n"))
    return per.groupBy("doc", "page").agg(F.max(F.struct("n", "s", "f")).alias("b")).select("doc", "page", F.col("b.s").alias("body"), F.col("b.f").alias("body_font"))


def is_name(r: Reader, text: Column, size: Column, body: Column) -> Column:
    """Does a line look like a name?"""
    unit = body if r.relative else F.lit(1.0)
    words = F.size(F.split(text, r"\s+"))
    out = (size >= unit * r.size[0]) & (size <= unit * r.size[1]) & (words <= r.most_words) & text.rlike(r"^\p{Lu}") & ~F.lower(text).isin(*r.stop, "")
    if r.refused:
        out = out & ~text.rlike(r.refused)
    if r.only:
        out = out & F.lower(text).isin(*r.only)
    for pattern in r.labels.values():
        out = out & ~text.rlike(pattern)
    return out


def read_entries(lines: DataFrame, r: Reader) -> DataFrame:
    """``doc, page, col, line_no, name, section, fields, attributes, description`` of every entry that has what the reader needs."""
    place = ["doc", "page"] if r.whole_page else ["doc", "page", "col"]
    order = F.struct("page", "col", "line_no")
    rows = lines.withColumn("text", stripped(F.col("text"))).filter("text <> ''")
    if r.relative or r.display:
        rows = rows.join(body_sizes(rows), ["doc", "page"])
    else:
        rows = rows.withColumn("body", F.lit(1.0))
    text = F.col("text")
    section = F.lit(None).cast("string")
    for pattern, value in reversed(list(r.sections.items())):
        section = F.when(text.rlike(pattern) & (F.col("size") >= r.section_size), F.lit(value)).otherwise(section)
    rows = rows.withColumn("__section", section)
    name = is_name(r, text, F.col("size"), F.col("body"))
    if r.display:
        name = name & ~F.col("font").eqNullSafe(F.col("body_font"))
    rows = rows.withColumn("__name", name & F.col("__section").isNull())
    if r.sections:
        # A document's section headings are few; only they are ordered over the whole of it.
        heads = rows.filter("__section is not null").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("__section").alias("s")))).alias("__heads"))
        before = F.filter("__heads", lambda h: h["o"] <= order)
        rows = rows.join(heads, "doc", "left").withColumn("section", F.coalesce(F.try_element_at(before, F.lit(-1))["s"], F.lit(r.first_section))).drop("__heads")
    else:
        rows = rows.withColumn("section", F.lit(r.first_section).cast("string"))
    w = Window.partitionBy(*place).orderBy("page", "col", "line_no")
    opens = F.col("__name") | F.col("__section").isNotNull()
    rows = rows.withColumn("__entry", F.sum(F.when(opens, 1).otherwise(0)).over(w))
    entry = [*place, "__entry"]
    inside = Window.partitionBy(*entry).orderBy("page", "col", "line_no")
    rows = rows.withColumn("__head", F.first("__name").over(inside.rowsBetween(Window.unboundedPreceding, 0))).filter("__head")
    body = ~F.col("__name")
    # Stat rows.
    header = body & text.rlike(r.header) if r.header else F.lit(False)
    rows = rows.withColumn("__header", header).withColumn("__behind", F.lag("__header", 1, False).over(inside) & body & ~F.col("__header"))
    rows = rows.withColumn("__mark", F.lag(text.rlike(r.optional_mark) if r.optional_mark else F.lit(False), 1, False).over(inside))
    bare = text.rlike(r.bare) & body if r.bare else F.lit(False)
    rows = rows.withColumn("__stats", F.col("__behind") | bare)
    # Labels.
    label = F.lit(None).cast("string")
    for key, pattern in reversed(list(r.labels.items())):
        label = F.when(text.rlike(pattern), F.lit(key)).otherwise(label)
    rows = rows.withColumn("__label", F.when(body & ~F.col("__header") & ~F.col("__stats"), label))
    if not r.last_wins:
        nth = F.row_number().over(Window.partitionBy(*entry, "__label").orderBy("page", "col", "line_no"))
        rows = rows.withColumn("__label", F.when((nth == 1) | F.col("__label").isin(*r.joined, ""), F.col("__label")))
    rows = rows.withColumn("__part", F.sum(F.when(F.col("__label").isNotNull(), 1).otherwise(0)).over(inside))
    part = Window.partitionBy(*entry, "__part").orderBy("page", "col", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__open", F.first("__label").over(part))
    low = text.rlike(r"^\p{Ll}")
    rows = rows.withColumn("__broken", F.max(F.when(F.col("__label").isNull() & body & ~low, 1).otherwise(0)).over(part))
    how = F.lit(r.after_all)
    for key, kind in r.after.items():
        how = F.when(F.col("__open") == key, F.lit(kind)).otherwise(how)
    plain = body & F.col("__label").isNull() & ~F.col("__header") & ~F.col("__stats")
    goes_on = plain & F.col("__open").isNotNull() & ((how == "open") | ((how == "lower") & (F.col("__broken") == 0)))
    dropped = plain & F.col("__open").isNotNull() & (how == "drop")
    value = F.lit(None).cast("string")
    for key, pattern in r.labels.items():
        value = F.when(F.col("__label") == key, stripped(F.regexp_extract(text, pattern, 1))).otherwise(value)
    rows = rows.withColumn("__value", F.when(goes_on, text).otherwise(value))
    is_text = plain & ~goes_on & ~dropped
    if r.display:
        is_text = is_text & F.col("font").eqNullSafe(F.col("body_font"))
    piece = F.struct(order.alias("o"), "__open", "__part", F.col("__value").alias("v"))
    stat = F.struct(order.alias("o"), text.alias("t"), F.col("__mark").alias("mark"), F.col("__behind").alias("behind"))
    found = rows.groupBy(*entry).agg(
        F.min_by(F.struct("page", "col", "line_no", F.col("text").alias("name"), "section"), order).alias("h"),
        F.array_sort(F.collect_list(F.when(F.col("__value").isNotNull(), piece))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("__stats"), stat))).alias("stats"),
        F.array_sort(F.collect_list(F.when(is_text, F.struct(order.alias("o"), text.alias("t"))))).alias("texts"),
        *(F.max_by(stripped(F.regexp_extract(text, p, 1)), F.when(body & text.rlike(p), order)).alias(f"any{i}") for i, p in enumerate(r.labels.values() if r.several else [])),
    )

    def collected(key: str) -> Column:
        own = F.filter("pieces", lambda p: p["__open"] == key)
        last = own if key in r.joined or not r.last_wins else F.filter(own, lambda p: p["__part"] == F.try_element_at(own, F.lit(-1))["__part"])
        return F.struct(F.lit(key).alias("k"), stripped(F.array_join(F.transform(last, lambda p: p["v"]), " ")).alias("v"), (F.size(own) > 0).alias("there"))

    if r.several:
        fields = [F.struct(F.lit(k).alias("k"), F.col(f"any{i}").alias("v"), F.col(f"any{i}").isNotNull().alias("there")) for i, k in enumerate(r.labels)]
    else:
        fields = [collected(k) for k in r.labels]
    if r.value_fields:
        row = F.get(F.filter("stats", lambda s: s["t"].rlike(r.values)), 0)["t"]
        fields += [F.struct(F.lit(k).alias("k"), stripped(F.regexp_extract(row, r.values, i + 1)).alias("v"), row.isNotNull().alias("there")) for i, k in enumerate(r.value_fields)]
    present = F.filter(F.array(*fields), lambda f: f["there"] & (f["v"] != "")) if fields else None
    as_map = F.map_from_entries(F.transform(present, lambda f: F.struct(f["k"], f["v"]))) if fields else F.expr("cast(map() as map<string,string>)")
    attributes = F.lit(None).cast("map<string,string>")
    if r.attributes:
        whole, short = F.array(*map(F.lit, r.attributes)), F.array(*(F.lit(a) for a in r.attributes if a != r.optional))

        def zipped(s: Column) -> Column:
            tokens = F.regexp_extract_all(s["t"], F.lit(f"({r.token})"), F.lit(1))
            keys = whole if r.optional is None else F.when(F.when(s["behind"] & F.lit(r.optional_mark is not None), s["mark"]).otherwise(F.size(tokens) == len(r.attributes)), whole).otherwise(short)
            return F.when(F.size(tokens) >= F.size(keys), F.map_from_arrays(keys, F.slice(tokens, 1, F.size(keys))))

        attributes = F.get(F.filter(F.transform("stats", zipped), lambda m: m.isNotNull()), 0)
    description = dehyphenate(F.transform("texts", lambda t: t["t"]))
    out = found.select("doc", "h.page", "h.col", "h.line_no", "h.name", "h.section", as_map.alias("fields"), attributes.alias("attributes"), F.when(F.length(description) >= r.least, description).alias("description"))
    for group in r.needed:
        there = F.lit(False)
        for key in group:
            there = there | (F.col("attributes").isNotNull() if key == "attributes" else F.col("description").isNotNull() if key == "text" else F.coalesce(F.try_element_at("fields", F.lit(key)).isNotNull(), F.lit(False)))
        out = out.filter(there)
    if r.unwanted:
        out = out.filter(~F.lower("name").isin(*r.unwanted))
    if r.unwanted_pattern:
        out = out.filter(~F.col("name").rlike(r.unwanted_pattern))
    if r.trimmed:
        out = out.withColumn("name", stripped(F.regexp_replace("name", r.trimmed, "")))
    if r.once:
        first = F.row_number().over(Window.partitionBy("doc", F.lower("name")).orderBy("page", "col", "line_no"))
        out = out.withColumn("__n", first).filter("__n = 1").drop("__n")
    return out


def share_description(entries: DataFrame, group: Column) -> DataFrame:
    """Entries without a description take that of the next one in their document that has one, if it is of the same ``group``; ``shared`` says so."""
    rows = entries.withColumn("__g", group)
    after = Window.partitionBy("doc").orderBy("page", "col", "line_no").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(F.col("description").isNotNull(), F.struct("__g", "description")), True).over(after)
    rows = rows.withColumn("__f", following)
    taken = F.col("description").isNull() & F.col("__f").isNotNull() & (F.col("__f.__g") == F.col("__g"))
    return rows.withColumn("shared", taken).withColumn("description", F.when(taken, F.col("__f.description")).otherwise(F.col("description"))).drop("__g", "__f")


#: The categories of spells, the words that stand for abbreviations, the attributes of skills.
SPELL_CATEGORIES = ("COMBAT", "DETECTION", "HEALTH", "ILLUSION", "MANIPULATION")
DURATIONS = {"I": "instantaneous", "S": "sustained", "P": "permanent"}
SKILL_ATTRIBUTES = {
    "astral": "Intuition", "athletics": "Agility", "biotech": "Logic", "close combat": "Agility", "con": "Charisma", "conjuring": "Magic", "cracking": "Logic",
    "electronics": "Logic", "enchanting": "Magic", "engineering": "Logic", "exotic weapons": "Agility", "firearms": "Agility", "influence": "Charisma",
    "perception": "Intuition", "piloting": "Reaction", "sorcery": "Magic", "stealth": "Agility", "tasking": "Resonance", "outdoors": "Intuition",
}
#: Keys of attribute rows.
CREATURE = ("bod", "agi", "rea", "str", "wil", "log", "int", "cha", "mag", "ess")
PERSON = ("bod", "agi", "rea", "str", "wil", "log", "int", "cha", "edg", "magres", "ess")

_HEADING = Reader((1.22, 99.0), relative=True, refused=r"//|:|^[^\p{Ll}]*$")
#: The rules of each kind of entry (sizes, stop lists, labels, headers).
READERS: dict[str, Reader] = {
    "spell": Reader(
        (12.4, 13.6), refused=r"\(", sections={rf"(?i)^{c.lower()}\s+spells\b": c for c in SPELL_CATEGORIES}, labels={"descriptor": r"^\(([^)]+)\)$"},
        header=r"(?i)RANGE\s+TYPE\s+DURATION\s+DV", values=r"(?i)^(LOS(?:\s*\(A\))?|Touch|T|Self)\s+([PM])\s+([ISP])\s+(\d+)\s*(.*?)\.*$",
        value_fields=("range", "spellType", "duration", "drain", "damage"), least=41,
    ),
    "ritual": Reader(
        (12.4, 99.0), stop=("rituals", "ritual failure", "ritual spellcasting", "ritual team", "glitches", "step", "magic spells"), refused=r"\(|Step$",
        labels={"keywords": r"^\(([A-Z][A-Za-z ,/-]+)\)$", "threshold": r"(?i)^Threshold:\s*(.+)$"}, needed=(("keywords", "threshold"),),
    ),
    "adept power": Reader(
        (12.4, 13.6), stop=("adepts", "power points", "adept powers", "magic", "spells"), refused=r"(?i)^(?:cost|activation)",
        labels={"cost": r"(?i)^Cost:\s*(.+)$", "activation": r"(?i)^Activation:\s*(.*?)\s*\d*$"}, needed=(("cost", "activation"),),
    ),
    "quality": Reader(
        (12.4, 13.6), most_words=6, stop=("qualities", "positive qualities", "negative qualities", "cost", "bonus", "game effect"), first_section="POSITIVE", section_size=14.5,
        sections={"(?i)^positive qualities": "POSITIVE", "(?i)^negative qualities": "NEGATIVE"},
        labels={"cost": r"(?i)^[^A-Za-z]*(?:Cost|Bonus):\s*(.+)$", "effect": r"(?i)^[^A-Za-z]*Game Effect:\s*(.*)$"}, after={"cost": "drop", "effect": "open"}, joined=("effect",), needed=(("cost",),), least=31,
    ),
    "skill": Reader((14.5, 15.6), most_words=3, labels={"specializations": r"(?i)^Specializations?:\s*(.+)$"}, needed=(("specializations",),)),
    "lifestyle": Reader((14.5, 99.0), only=("street", "squatter", "low", "middle", "high", "luxury"), labels={"cost": r"(?i)^[^A-Za-z]*Cost:\s*(.+)$"}, needed=(("cost",),)),
    "toxin or drug": Reader(
        (12.4, 13.6), most_words=6, refused="(?i)^from ", first_section="TOXIN", section_size=14.5, sections={"(?i)^toxins$": "TOXIN", "(?i)^drugs$": "DRUG"},
        stop=("toxins", "drugs", "concentration", "antidotes", "vector", "speed", "duration", "power", "effect", "toxins and drugs", "designer improvements"),
        labels={k: rf"(?i)^[^A-Za-z]*{p}\b:?\s*(.*)$" for k, p in (("vector", "Vector"), ("speed", "Speed"), ("duration", "Duration"), ("power", "Power"), ("effect", "Effect"), ("addictionRating", "Addiction Rating"), ("addictionType", "Addiction Type"), ("addiction", "Addiction"))},
        last_wins=True, after_all="open", after={"effect": "text"}, needed=(("vector",),), least=31,
    ),
    "spirit": Reader(
        (1.15, 99.0), relative=True, most_words=6, whole_page=True, refused=r"(?i)^(?!(?:spirits?\s+of\s+[A-Za-z]\w+|[A-Za-z][\w'-]*(?:\s+[\w'-]+){0,2}\s+spirits?\b))",
        labels={"optionalPowers": "^Optional Powers:(.*)$", "powers": "^Powers:(.*)$", "attacks": "^Attacks:(.*)$", "defenseRating": "^Defense Rating:(.*)$"}, last_wins=True, after_all="lower",
        header=r"\bB A R S W L I C M ESS\b", attributes=CREATURE, token=r"\bF[^\s]*", needed=(("attributes",),),
    ),
    "critter": replace(
        _HEADING, most_words=4, whole_page=True, refused=r"//|[:.,\d]|^[^\p{Ll}]*$|\bB A R S W L I C (?:M )?ESS\b", stop=("critters", "mundane critters", "awakened critters", "dracoforms", "powers", "skills"),
        labels={"skills": "^Skills:(.*)$", "powers": "^Powers:(.*)$", "movement": "^Movement:(.*)$", "weaknesses": "^Weaknesses?:(.*)$", "notes": "^Notes:(.*)$"}, last_wins=True, after_all="lower",
        header=r"\bB A R S W L I C (?:M )?ESS\b", attributes=CREATURE, optional="mag", optional_mark=r"\bB A R S W L I C M ESS\b", bare=r"^\d{1,2}(?: \d{1,2}(?:\.\d)?){8,9}$", needed=(("attributes",), ("powers",)),
    ),
    "complex form": replace(
        _HEADING, stop=("complex forms", "sprites", "matrix", "technomancers", "registering a sprite"), trimmed=r"\s*\(.*\)$", header=r"(?i)^FADE\s+VALUE\s+DURATION", values=r"(?i)^([–—\-\d]+)\s+([ISP])\b",
        value_fields=("fading", "duration"), needed=(("fading",),),
    ),
    "contact": replace(
        _HEADING, most_words=4, stop=("contacts", "connection", "loyalty", "making contact", "using contacts"), last_wins=True, several=True, least=20,
        labels={"connection": r"(?i)Connection\s*(?:Rating)?\s*[:=]?\s*(\d+)", "loyalty": r"(?i)Loyalty\s*(?:Rating)?\s*[:=]?\s*(\d+)"}, needed=(("connection", "loyalty"),),
    ),
    "martial style": replace(
        _HEADING, whole_page=True, stop=("martial arts", "martial art", "styles", "techniques", "the basics"), labels={"techniques": "(?i)^Techniques?:(.*)$"}, last_wins=True, after_all="lower", needed=(("techniques",),), least=40,
    ),
    "martial technique": Reader(
        (12.5, 14.5), display=True, stop=("martial arts", "martial art", "styles", "techniques", "the basics"), needed=(("text",),), least=40, once=True,
        unwanted=("any attack", "any strike", "grapple", "any melee", "any action", "any test", "any combat", "any ranged"),
        unwanted_pattern=r"(?i)[?,/]|\b(?:your|through|versus|when to|part of|installing|weapon details|specialization)\b|(?-i:^(?:An|A) [A-Z])",
    ),
    "critter power": replace(
        _HEADING, most_words=4, stop=("powers", "critters", "critter powers", "the awakened world", "mundane critters", "awakened critters", "dracoforms", "optional powers"), trimmed=r"(?i)\s+(?:of|the|a|and|to|with)$",
        header=r"(?i)^TYPE\s+ACTION\s+RANGE\s+DURATION", values=r"^([PM])\s+(\S+)\s+(\S+(?:\s*\([^)]*\))?)\s+(Instant(?:aneous)?|Always|Sustained|Permanent|Special|Varies|Never)\b",
        value_fields=("type", "action", "range", "duration"), needed=(("type",),),
    ),
}


def read_spells(lines: DataFrame) -> DataFrame:
    """Spells with ``category``, from the descriptor or else the section; those without are dropped. A description printed once for a group is shared."""
    e = read_entries(lines, READERS["spell"])
    said = F.upper(F.concat_ws(" ", F.try_element_at("fields", F.lit("descriptor")), "section"))
    category = F.coalesce(*(F.when(said.contains(c), F.lit(c)) for c in SPELL_CATEGORIES))
    e = e.withColumn("fields", F.transform_values("fields", lambda k, v: F.when(k == "range", F.replace(F.upper(v), F.lit(" "), F.lit(""))).when(k.isin("spellType", "duration"), F.upper(v)).otherwise(v)))
    return share_description(e.withColumn("category", category).filter("category is not null"), F.col("category"))


def read_skills(lines: DataFrame) -> DataFrame:
    """Skills with the ``attribute`` they are linked to, null for unknown ones."""
    table = F.create_map(*[F.lit(x) for kv in SKILL_ATTRIBUTES.items() for x in kv])
    return read_entries(lines, READERS["skill"]).withColumn("attribute", F.try_element_at(table, F.lower("name")))


def read_blocks(lines: DataFrame, labels: Mapping[str, str], refused: Sequence[str] = ()) -> DataFrame:
    """Stat blocks of persons: ``doc, page, col, line_no, name, fields, attributes, description``. A block begins at 'Metatype:' or at an attribute header that belongs to no
    such line before it; its name is the last title-like line between the anchor before and its own. Only blocks with attributes (ten numbers, or eleven) are entries."""
    header = r"\bB\s+A\s+R\s+S\s+W\s+L\s+I\s+C\s+EDG\s+(?:(?:M|RES|R)\s+)?ESS\b"
    rows = lines.withColumn("text", stripped(F.col("text"))).filter("text <> ''")
    text = F.col("text")
    w = Window.partitionBy("doc", "page", "col").orderBy("line_no")
    kind = F.when(text.rlike(r"(?i)^Metatype:\s*\S"), "m").when(text.rlike(header), "h")
    rows = rows.withColumn("__kind", kind).withColumn("__last", F.last("__kind", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    anchor = (F.col("__kind") == "m") | ((F.col("__kind") == "h") & ~F.coalesce(F.col("__last") == "m", F.lit(False)))
    rows = rows.withColumn("__anchor", F.coalesce(anchor, F.lit(False)))
    title = ~text.rlike(r"[:/()\d]|^\p{Ll}") & (F.size(F.split(text, r"\s+")) <= 5) & ~F.lower(text).isin(*refused, "") & ~text.rlike(r"(?:^|\s)\p{Ll}") & F.col("__kind").isNull()
    rows = rows.withColumn("__block", F.sum(F.when(F.col("__anchor"), 1).otherwise(0)).over(w)).withColumn("__title", F.when(title, text))
    before = Window.partitionBy("doc", "page", "col").orderBy("line_no")
    rows = rows.withColumn("__run", F.sum(F.when(F.lag("__anchor", 1, False).over(before), 1).otherwise(0)).over(w))
    named = Window.partitionBy("doc", "page", "col", "__run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__name", F.last("__title", True).over(named)).filter("__block > 0")
    # From here on a block is an entry whose name line is its anchor.
    marked = rows.select("doc", "page", "col", "line_no", F.when(F.col("__anchor"), 99.0).otherwise(1.0).alias("size"), F.when(F.col("__anchor"), F.concat(F.lit("X "), F.coalesce("__name", F.lit("NPC")))).otherwise(text).alias("text"))
    repeated = rows.filter("__anchor").select("doc", "page", "col", (F.col("line_no") + 0.5).alias("line_no"), F.lit(1.0).alias("size"), "text")
    marked = marked.withColumn("line_no", F.col("line_no").cast("double")).unionByName(repeated)
    number = r"\d+(?:\.\d+)?(?:\(\d+\))?"
    reader = Reader(
        (99.0, 99.0), most_words=99, labels={"metatype": r"(?i)^Metatype:\s*([A-Za-z]+)", **{k: rf"(?i)^{p}\s*(.*)$" for k, p in labels.items()}}, last_wins=True, after_all="lower", header=header,
        attributes=PERSON, token=number, optional="magres", bare=r"^\d{1,2}(?:\(\d+\))?(?: \d{1,2}(?:\(\d+\))?){8,9} \d+\.\d+$", needed=(("attributes",),), least=41,
    )
    out = read_entries(marked, replace(reader, refused=None))
    plain = F.transform_values("attributes", lambda k, v: F.regexp_replace(v, r"\(.*\)", ""))
    return out.withColumn("name", F.regexp_replace("name", "^X ", "")).withColumn("attributes", plain).withColumn("line_no", F.col("line_no").cast("int")).drop("section")


def read_actors(lines: DataFrame, labels: Sequence[str], least: float = 17.0) -> DataFrame:
    """``doc, page, name, fields, description`` of pages whose largest text, of that size at least, is a name and that say 'metatype:'; the prose is what stands before it."""
    from tessera.operators.sequence import labelled_spans

    rows = lines.withColumn("text", stripped(F.col("text"))).filter("text <> ''")
    order = F.struct("col", "line_no")
    top = rows.groupBy("doc", "page").agg(F.max("size").alias("top"))
    joined = rows.join(top, ["doc", "page"]).withColumn("__big", (F.col("size") == F.col("top")) & (F.col("top") >= least))
    pieces = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct(order.alias("o"), F.col("text").alias("t")))))
    page = joined.groupBy("doc", "page").agg(pieces(F.col("__big")).alias("n"), pieces(~F.col("__big")).alias("b"))
    page = page.withColumn("name", F.array_join(F.transform("n", lambda x: x["t"]), " ")).withColumn("body", F.array_join(F.transform("b", lambda x: x["t"]), "\n"))
    page = page.filter(F.length("name").between(2, 40) & ~F.col("name").rlike(r"^\d") & F.lower("body").contains("metatype:"))
    prose = dehyphenate(F.split(F.regexp_extract("body", r"(?is)^(.*?)metatype:", 1), "\n"))
    text = F.regexp_replace("body", r"(?i)metatype:", "Metatype:")
    return page.select("doc", "page", "name", labelled_spans(F.regexp_replace(text, r"\s+", " "), ["Metatype", *labels]).alias("fields"), F.when(F.length(prose) > 40, prose).alias("description"))


def read_complex_forms(lines: DataFrame) -> DataFrame:
    """Complex forms; fading with a plain minus, duration as a word."""
    table = F.create_map(*[F.lit(x) for kv in DURATIONS.items() for x in kv])
    e = read_entries(lines, READERS["complex form"])
    return e.withColumn("fields", F.transform_values("fields", lambda k, v: F.when(k == "duration", F.try_element_at(table, F.upper(v))).otherwise(F.regexp_replace(v, "[–—]", "-"))))


def read_critter_powers(lines: DataFrame) -> DataFrame:
    """Powers of critters; P is physical, M mana."""
    e = read_entries(lines, READERS["critter power"])
    return e.withColumn("fields", F.transform_values("fields", lambda k, v: F.when(k == "type", F.when(v == "P", "physical").otherwise("mana")).otherwise(v)))


def ruled_rows(rows: DataFrame, sections: Mapping[str, str], mark: str = "HAND", least: int = 8, width: int = 11) -> DataFrame:
    """``doc, page, row_no, section, name, stats``: rows (doc, page, row_no, cells) of ruled tables. A row whose second cell begins with ``mark`` is a header and opens the section
    its first cell names, if that is known; rows before the first section of their page, with fewer than ``least`` cells with a digit behind the name or a name of one letter
    are none. ``stats`` are padded or cut to ``width``; a number before a name is dropped."""
    plain = lambda c: stripped(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    table = F.create_map(*[F.lit(x) for kv in sections.items() for x in kv])
    cells = F.transform("cells", plain)
    marked = rows.withColumn("__c", cells).filter("__c[0] <> ''")
    header = F.coalesce(F.upper(F.get("__c", 1)).startswith(mark), F.lit(False))
    w = Window.partitionBy("doc", "page").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(header, F.try_element_at(table, F.upper(F.get("__c", 0))))
    marked = marked.withColumn("section", F.last(known, True).over(w)).withColumn("__stats", F.slice("__c", 2, F.greatest(F.size("__c") - 1, F.lit(0))))
    kept = marked.filter(~header & F.col("section").isNotNull() & (F.size(F.filter("__stats", lambda s: s.rlike(r"\d"))) >= least))
    name = stripped(F.regexp_replace(F.get("__c", 0), r"^\d+\s+", ""))
    return kept.select("doc", "page", "row_no", "section", name.alias("name"), F.slice(F.concat("__stats", F.array_repeat(F.lit(""), width)), 1, width).alias("stats")).filter(F.length("name") > 1)


def spread_rows(lines: DataFrame, header: Column, row: str, above: int = 6, below: int = 3, least: int = 11) -> DataFrame:
    """``doc, page, col, line_no, name, subtype, stats``: for each header line the nearest 'Name (subtype)' in the ``above`` lines before it, else the nearest '(subtype)' that
    stands alone below a plausible name; and the first of the ``below`` lines behind it that fits ``row``, of ``least`` tokens. Both must be there."""
    rows = lines.withColumn("text", stripped(F.col("text"))).filter("text <> ''")
    w = Window.partitionBy("doc", "page", "col").orderBy("line_no")
    before = F.collect_list(F.col("text")).over(w.rowsBetween(-above, -1))
    behind = F.collect_list(F.col("text")).over(w.rowsBetween(1, below))
    plausible = lambda n: F.length(n).between(3, 40) & n.rlike(r"^\p{Lu}") & ~n.rlike("[:]|^>") & (F.size(F.split(n, r"\s+")) <= 6)
    whole = r"^(.+?)\s*\(([^)]+)\)\s*$"
    named = F.try_element_at(F.filter("__up", lambda t: t.rlike(whole) & plausible(stripped(F.regexp_extract(t, whole, 1)))), F.lit(-1))
    alone = F.transform("__up", lambda t, i: F.when(t.rlike(r"^\([^)]+\)$") & (i > 0), F.struct(F.get("__up", i - 1).alias("n"), t.alias("t"))))
    split = F.try_element_at(F.filter(alone, lambda s: s.isNotNull() & plausible(s["n"])), F.lit(-1))
    found = rows.withColumn("__h", header).withColumn("__up", before).withColumn("__down", behind).filter("__h")
    found = found.withColumn("__named", named).withColumn("__split", split).withColumn("__row", F.get(F.filter("__down", lambda t: t.rlike(row)), 0))
    name = F.when(F.col("__named").isNotNull(), stripped(F.regexp_extract("__named", whole, 1))).otherwise(F.col("__split.n"))
    subtype = F.lower(F.when(F.col("__named").isNotNull(), stripped(F.regexp_extract("__named", whole, 2))).otherwise(F.regexp_extract("__split.t", r"^\((.*)\)$", 1)))
    stats = F.split("__row", r"\s+")
    return found.select("doc", "page", "col", "line_no", name.alias("name"), subtype.alias("subtype"), F.when(F.size(stats) >= least, F.slice(stats, 1, least)).alias("stats")).filter("name is not null and stats is not null")


#: Sizes of module names and of labels in points, how far a size may be off, and the glyph that opens a grant.
MODULE_SIZE, LABEL_SIZE, SIZE_SLACK, BULLET = 17.8, 13.0, 0.35, "•"


def read_modules(spans: DataFrame) -> DataFrame:
    """``doc, page, name, description, grants`` of life modules; ``spans`` are pieces of text in order (doc, page, span_no, size, text, font). Large spans are a name, joined if they
    follow each other; the bullet glyph opens a grant {label, value}; a module goes on over page ends. Text in a sans font is furniture. The name of a module without
    grants belongs to the one behind it."""
    text = stripped(F.col("text"))
    rows = spans.withColumn("text", text).filter("text <> ''")
    near = lambda size: F.abs(F.col("size") - size) < SIZE_SLACK
    rows = rows.withColumn("__head", near(MODULE_SIZE)).withColumn("__bullet", ~F.col("__head") & (F.col("text") == BULLET))
    w = Window.partitionBy("doc").orderBy("page", "span_no")
    rows = rows.withColumn("__first", F.col("__head") & ~F.coalesce(F.lag("__head").over(w), F.lit(False)))
    rows = rows.withColumn("__module", F.sum(F.when(F.col("__first"), 1).otherwise(0)).over(w)).filter("__module > 0")
    rows = rows.withColumn("__grant", F.sum(F.when(F.col("__bullet"), 1).otherwise(0)).over(Window.partitionBy("doc", "__module").orderBy("page", "span_no")))
    rows = rows.filter(F.col("__head") | F.col("__bullet") | ~F.coalesce(F.col("font").contains("Sans"), F.lit(False)))
    label = r"^(.*?):\s*$"
    is_label = ~F.col("__head") & ~F.col("__bullet") & near(LABEL_SIZE) & (F.col("__grant") > 0) & F.col("text").rlike(label)
    order = F.struct("page", "span_no")
    joined = lambda c, v=F.col("text"): F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(order.alias("o"), v.alias("t"))))), lambda x: x["t"]), " ")
    value = ~F.col("__head") & ~F.col("__bullet") & ~is_label
    grants = rows.groupBy("doc", "__module", "__grant").agg(
        F.min(F.when(F.col("__head"), F.col("page"))).alias("page"), joined(F.col("__head")).alias("name"), joined(value).alias("value"),
        F.coalesce(F.max_by(stripped(F.regexp_extract("text", label, 1)), F.when(is_label, order)), F.lit("")).alias("label"),
    )
    one = grants.groupBy("doc", "__module").agg(
        F.min("page").alias("page"), F.max(F.when(F.col("__grant") == 0, F.col("name"))).alias("name"), F.max(F.when(F.col("__grant") == 0, F.col("value"))).alias("description"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("__grant") > 0, F.struct(F.col("__grant").alias("g"), "label", "value")))), lambda x: F.struct(x["label"], x["value"])).alias("grants"),
    )
    m = Window.partitionBy("doc").orderBy("__module")
    run = F.coalesce(F.sum(F.when(F.size("grants") > 0, 1).otherwise(0)).over(m.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = F.array_join(F.collect_list("name").over(Window.partitionBy("doc", "__run").orderBy("__module").rowsBetween(Window.unboundedPreceding, 0)), " ")
    return one.withColumn("__run", run).withColumn("name", names).filter(F.size("grants") > 0).select("doc", "page", "name", "description", "grants")


#: Fixed value: a line that is a price or a piece of one.
PRICE_LINE = r"^[\d,./]+[¥�]?$"


def unwrapped_names(lines: DataFrame, name: str, refused: str | None = None, words: int = 3) -> DataFrame:
    """``doc, page, line_no, name``: names of stat rows (lines whose ``name`` is not null) put together with the part of the name in the line before, one price line skipped, and in the line behind.
    Each line is used once, in the order of the rows; a line that ends with - or / opens a name, so it closes none. ``words``: a part has at most so many."""
    from tessera.operators.folds import fold_sorted

    part = (F.size(F.split("text", r"\s+")) <= words) & F.col("text").rlike(r"\p{L}") & ~F.col("text").rlike(PRICE_LINE)
    if refused:
        part = part & ~F.col("text").rlike(refused)
    rows = lines.withColumn("text", stripped(F.coalesce("text", F.lit("")))).select("doc", "page", "line_no", "text", F.col(name).alias("__name"), (part & F.col(name).isNull()).alias("__part"), F.col("text").rlike(PRICE_LINE).alias("__price"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def glued(head: str, tail: str) -> str:
        return head + tail if head.endswith(("-", "/")) else f"{head} {tail}".strip()

    def start():
        # The last two lines (text, is a part still free, is a price), and a row whose next line is awaited.
        last: list[list] = []
        waiting: list = []

        def closed(follower: list | None) -> list[tuple]:
            if not waiting:
                return []
            key, found = waiting[0]
            waiting.clear()
            if follower is not None and follower[1] and not follower[0].endswith(("-", "/")):
                follower[1] = False
                found = glued(found, follower[0])
            return [(*key, found)]

        def step(row):
            doc, page_no, number, text, own, is_part, is_price = row
            line = [text, bool(is_part), bool(is_price)]
            out = closed(line)
            if own is not None:
                found = own
                for back in reversed(last):
                    if back[2]:
                        continue
                    if back[1]:
                        back[1] = False
                        found = glued(back[0], found)
                    break
                waiting.append(((doc, page_no, number), found))
            last.append(line)
            del last[:-2]
            return out

        return step, lambda: closed(None)

    schema = f"doc {kinds['doc']}, page {kinds['page']}, line_no {kinds['line_no']}, name string"
    return fold_sorted(rows, ["doc", "page"], ["line_no"], start, schema)


def display_names(lines: DataFrame) -> DataFrame:
    """``doc, page, band, name, subtype``: the name set beside each stat block. ``lines``: doc, page, band, side ('above', 'below'), place (1 is nearest), text, strict and relaxed
    (is it set apart, by the narrow and by the wide rule). Four passes, strict above and below, then relaxed; the first that finds a name counts. A pass walks outward to the first line
    that is not set apart and puts the pieces of the name together; a line in parentheses is the subtype, a lone word in lower case says nothing."""
    tail = r"(?i)\s*\(p\.\s*\d+.*?\)\s*$"
    piece = F.struct("place", "side", stripped(F.col("text")).alias("t"), "strict", "relaxed")
    bands = lines.groupBy("doc", "page", "band").agg(F.array_sort(F.collect_list(piece)).alias("ls"))

    def walk(flag: str, side: str) -> Column:
        def step(state: Column, line: Column) -> Column:
            subtype = F.regexp_extract(line["t"], r"^\((.{2,45})\)$", 1)
            is_sub = (subtype != "") & state["subtype"].isNull()
            core = stripped(F.regexp_replace(F.regexp_replace(line["t"], tail, ""), r"\s*\(.*$", ""))
            lone = line["t"].rlike(r"^\p{Ll}[^\s\p{Lu}]*$")
            named = F.length(core).between(2, 60) & ~core.rlike(r"^\d+$") & ~lone
            joined = F.concat_ws(" ", core, state["name"]) if side == "above" else F.concat_ws(" ", state["name"], core)
            name = F.when(~is_sub & line[flag] & named, joined).otherwise(state["name"])
            following = F.struct(name.alias("name"), F.when(is_sub, subtype).otherwise(state["subtype"]).alias("subtype"), (~is_sub & ~line[flag]).alias("done"))
            return F.when(state["done"], state).otherwise(following)

        empty = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("subtype"), F.lit(False).alias("done"))
        found = F.aggregate(F.filter("ls", lambda x: x["side"] == side), empty, step)
        return F.when(found["name"].isNotNull(), F.struct(found["name"].alias("name"), found["subtype"].alias("subtype")))

    best = F.coalesce(*(walk(flag, side) for flag in ("strict", "relaxed") for side in ("above", "below")))
    out = bands.select("doc", "page", "band", best.alias("b")).filter("b is not null")
    subtype = stripped(F.regexp_replace(F.regexp_replace("b.subtype", tail, ""), r",\s*(?:p\.|dc|cr)\b.*$", ""))
    return out.select("doc", "page", "band", "b.name", subtype.alias("subtype"))


def rows_under_band(lines: DataFrame, fields: int, gap: float = 26.0, reach: float = 30.0) -> DataFrame:
    """``doc, page, band, line_no, name, vals``: the value rows under a band of captions. ``lines``: doc, page, band, band_top, line_no, top, bottom, lead (the text left of the cells)
    and vals (map from field to text, of ``fields``). A row has three fifths of the fields, four at least, and half of them as numbers. The block ends at a gap of more than
    ``gap`` or, behind its first row, at a line that is neither row nor part of a name. Parts of names on lines of their own go to the nearest row without a name (to any, if all
    have one) within ``reach``, in front of its name or behind it."""
    keys = ["doc", "page", "band"]
    w = Window.partitionBy(*keys).orderBy("line_no")
    filled, numeric = F.size(F.map_keys("vals")), F.size(F.filter(F.map_values("vals"), lambda v: v.rlike(r"^[+\-–—]?[\d.,/]+[¥%]?$|^[—–-]$")))
    rows = lines.withColumn("__lead", stripped(F.coalesce("lead", F.lit("")))).withColumn("__ok", (filled >= max(4, fields * 6 // 10)) & (numeric >= max(3, fields // 2)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__seen", F.coalesce(F.max("__ok").over(before), F.lit(False)))
    rows = rows.withColumn("__orphan", ~F.col("__ok") & F.col("__seen") & (filled == 0) & F.length("__lead").between(3, 59))
    far = F.col("top") - F.coalesce(F.lag("bottom").over(w), F.col("band_top")) > gap
    rows = rows.withColumn("__stop", far | (F.col("__seen") & ~F.col("__ok") & ~F.col("__orphan")))
    rows = rows.withColumn("__over", F.max("__stop").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("not __over").withColumn("__mid", (F.col("top") + F.col("bottom")) / 2)
    entry = F.struct(F.col("__mid").alias("m"), F.col("__lead").alias("t"), "line_no", "vals")
    block = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("__orphan"), F.struct(F.col("__mid").alias("m"), F.col("__lead").alias("t"))))).alias("parts"), F.collect_list(F.when(F.col("__ok"), entry)).alias("rs"))
    block = block.withColumn("rs", F.array_sort("rs", lambda a, b: F.when(a["line_no"] < b["line_no"], -1).when(a["line_no"] > b["line_no"], 1).otherwise(0)))
    blank = F.filter("rs", lambda r: r["t"] == "")
    free = F.when(F.size(blank) > 0, blank).otherwise(F.col("rs"))
    nearest = lambda p: F.array_min(F.transform(free, lambda r: F.struct(F.abs(r["m"] - p["m"]).alias("d"), r["line_no"].alias("n"))))
    block = block.withColumn("taken", F.filter(F.transform("parts", lambda p: F.struct(p["m"].alias("m"), p["t"].alias("t"), nearest(p).alias("to"))), lambda p: p["to"]["d"] <= reach))
    one = block.select(*keys, F.explode("rs").alias("r"), "taken")
    own = F.filter("taken", lambda p: p["to"]["n"] == F.col("r.line_no"))
    texts = F.concat(F.transform(F.filter(own, lambda p: p["m"] < F.col("r.m")), lambda p: p["t"]), F.array("r.t"), F.transform(F.filter(own, lambda p: p["m"] >= F.col("r.m")), lambda p: p["t"]))
    return one.select(*keys, "r.line_no", F.array_join(F.filter(texts, lambda t: t != ""), " ").alias("name"), "r.vals")
