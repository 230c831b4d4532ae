"""Personal data: surrogate generation (native).

Detected entities are replaced by keyed surrogates of the same type and shape:
an e-mail by an e-mail, a card number by one that passes its check digit, a
name by a name of the same gender and script, punctuation and length kept.

* The same entity (after normalising case and punctuation) gets the same
  surrogate wherever it stands, so references stay together.
* Surrogates come from SHA-512 of key, type, attempt and entity.  The table of
  all different entities is then checked: a surrogate that two entities share,
  or that is itself an entity of the corpus, is drawn again for all but one of
  them, until none is left.  Different entities stay different.

Names are found behind a title, and then wherever their words stand in the same
document; the README lists what is not found.

Texts without an entity pass by unshuffled; only the others meet the surrogate
table, by their digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcinglens.llm.common import cut, pick, spread_join

#: What introduces a name, by the gender it tells.
MALE = "Mr|Mister|Sir|Lord|Herr|Monsieur|Señor|Don|Sig|Signor|господин"
FEMALE = "Mrs|Ms|Miss|Lady|Dame|Frau|Madame|Mme|Mlle|Mademoiselle|Señora|Señorita|Doña|Signora|госпожа"
EITHER = "Dr|Doctor|Doktor|Prof|Professor|Rev|Mx"
TITLE = f"{MALE}|{FEMALE}|{EITHER}"
_INNER = r"(?:['’-]\p{Lu}\p{L}+)"
_LAST = rf"\p{{Lu}}(?:[\p{{L}}\p{{M}}]+{_INNER}*|{_INNER}+)"
#: Up to three given names or initials, then a word of two letters or more.
NAME = rf"(?:(?:(?:\p{{Lu}}\.)+|\p{{Lu}}|{_LAST}) ){{0,3}}{_LAST}"
TITLED = rf"\b(?:{TITLE})\.? ({NAME})"
INITIAL = r"^(?:\p{Lu}|(?:\p{Lu}\.)+)$"
_KEY = r"(?i:token|api[_-]?key|secret|password|passwd|pwd|key)[\"']? ?[=:] ?"
_EDGE, _END = r"(?<![\p{L}\p{N}_.])", r"(?![\p{L}\p{N}_]|\.\d)"
_LOCAL = r"[\p{L}\p{N}._%+-]"

# Each pattern opens with what one character tells, so that at most places of a
# text nothing else is tried: an address is only looked for from the start of
# its run (or where the last match ended), a key word only behind a quote, = or
# :, a title only between a space and a capital.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@(?:[\p{{L}}\p{{N}}-]+\.)+\p{{L}}{{2,}}",
    "secret": rf"(?<=[\"'])(?<={_KEY}[\"'])[A-Za-z0-9_/+=.-]{{8,}}(?=[\"'])"
              rf"|(?<=[=:]|[=:] )(?<={_KEY})(?=[A-Za-z_/+=.-]*\d)[A-Za-z0-9_/+=.-]{{8,}}",
    "ip": _EDGE + r"(?:\d{1,3}\.){3}\d{1,3}" + _END,
    "ssn": _EDGE + r"\d{3}-\d{2}-\d{4}" + _END,
    "card": _EDGE + r"(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})" + _END,
    "phone": r"(?<![\p{L}\p{N}_+])(?:(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}"
             r"|0\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}|0\d(?:[ .-]\d{2}){4})(?!\d|\.\d)",
    "name": rf"(?<= )(?=\p{{Lu}})(?<=\b(?:{TITLE})\.? ){NAME}",
}
_NUMBERS = "|".join(f"(?:{PATTERNS[k]})" for k in ("ip", "ssn", "card", "phone"))
ANY = rf"(?:{PATTERNS['email']})|(?:{PATTERNS['secret']})|(?=[+(\d])(?:{_NUMBERS})|(?:{PATTERNS['name']})"

#: Letters a surrogate is drawn from, by the letters it stands for.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäçèéêëíîïñóôöùúûü",
             "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
             "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]


def luhn_sum(digits: Column) -> Column:
    """Check sum of a digit string, its last digit counted once."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda c: c.try_cast("int"))
    twice = F.transform(d, lambda x, i: F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x)


def kind_of(found: Column) -> Column:
    """Type of a matched text; null where a closer look says it is none."""
    digits = F.regexp_replace(found, r"\D", "")
    return (F.when(found.contains("@"), "email")
            .when(found.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"),
                  F.when(F.forall(F.split(found, r"\."), lambda o: o.try_cast("int") < 256), "ip"))
            .when(found.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
            .when(found.rlike(r"^(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})$"),
                  F.when(luhn_sum(digits) % 10 == 0, "card"))
            .when(found.rlike(r"^[+(\d][\d() .-]+$") & (F.length(digits) >= 7), "phone")
            .when(found.rlike(rf"^{NAME}$"), "name").otherwise("secret"))


def normal_form(kind: Column, found: Column) -> Column:
    """What names the entity: case and punctuation that don't tell are gone."""
    return (F.when(kind == "email", F.lower(found)).when(kind.isin("card", "phone", "ssn"), F.regexp_replace(found, r"\D", ""))
            .otherwise(found))


def _stream(key: str, attempt: Column, kind: Column, entity: Column, n: Column) -> Column:
    """At least ``n`` numbers 0..255, keyed by the entity."""
    block = F.transform(F.sequence(F.lit(0), (n / 64).cast("int")), lambda b: F.sha2(
        F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), entity, b.cast("string")), 512))
    pairs = F.regexp_extract_all(F.concat_ws("", block), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))


def _drawn(text: Column, numbers: Column, hex_only: Column) -> Column:
    """``text`` with every letter and digit drawn again from its own alphabet."""
    def one(c: Column, i: Column) -> Column:
        n = F.get(numbers, i)
        out = F.when(hex_only & c.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), n % 16 + 1, F.lit(1)))
        for a in ALPHABETS:
            out = out.when(F.instr(F.lit(a), c) > 0,
                           F.substring(F.lit(a), n % len(a) + 1, F.lit(1)))
        return out.when(c.rlike(r"\p{L}"), F.lit("x")).otherwise(c)
    return F.concat_ws("", F.transform(F.split(text, ""), one))


def draw(entities: DataFrame, key: str) -> DataFrame:
    """Adds ``name``, a surrogate of each entity's type and shape in normal
    form, to (kind, entity, attempt).  Step by step, as columns: a lambda that
    held the whole expression would work it out again for every letter."""
    kind, entity, attempt = F.col("kind"), F.col("entity"), F.col("attempt")
    d = entities.withColumn("_numbers", _stream(key, attempt, kind, entity, F.length(entity) + 8))
    d = d.withColumn("_drawn", _drawn(entity, F.col("_numbers"), (kind == "secret") & entity.rlike("^[0-9a-f]+$")))
    numbers, drawn = F.col("_numbers"), F.col("_drawn")
    local, domain = F.substring_index(drawn, "@", 1), F.substring_index(drawn, "@", -1)
    last = F.substring_index(entity, ".", -1)                                # the top-level domain stays
    # Small shapes run out of names: late attempts grow the local part.
    grown = F.when(attempt > 7, F.concat(local, F.format_string("%03d", F.get(numbers, F.lit(0))))).otherwise(local)
    email = F.concat(grown, F.lit("@"), F.regexp_replace(domain, r"\p{L}+$", ""), last)
    octets = F.transform(F.split(entity, r"\."), lambda o, i: F.when(
        (i == 0) & o.isin("10", "127", "192", "172"), o).otherwise((F.get(numbers, i) % 223 + 1).cast("string")))
    d = d.withColumn("_body", F.concat(F.substring(entity, 1, 1), F.substring(drawn, F.lit(2), F.length(drawn) - 2)))
    check = (10 - luhn_sum(F.concat("_body", F.lit("0"))) % 10) % 10
    code = F.greatest(F.lit(0), F.length(entity) - 10)                       # digits of a country code stay
    phone = F.concat(F.substring(entity, F.lit(1), code), F.substring(drawn, code + 1, F.length(drawn)))
    name = (F.when(kind == "email", email).when(kind == "ip", F.concat_ws(".", octets))
            .when(kind == "card", F.concat("_body", check.cast("string"))).when(kind == "phone", phone)
            .when(kind.startswith("given") | kind.startswith("family"), _name(kind, entity, numbers)).otherwise(drawn))
    return d.withColumn("name", name).drop("_numbers", "_drawn", "_body")


def _name(kind: Column, entity: Column, numbers: Column) -> Column:
    """A pronounceable name of the entity's script: two to four syllables, for
    a given name with an ending that fits its gender."""
    def built(consonants: str, vowels: str, male: str, female: str) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.get(numbers, 0) % 2 + 1), lambda i: F.concat(
            F.substring(F.lit(consonants), F.get(numbers, i * 2 + 1) % len(consonants) + 1, F.lit(1)),
            F.substring(F.lit(vowels), F.get(numbers, i * 2 + 2) % len(vowels) + 1, F.lit(1))))
        last = F.substring(F.lit(consonants), F.get(numbers, 7) % len(consonants) + 1, F.lit(1))
        end = F.when(kind == "given female", female).otherwise(male)
        return F.initcap(F.concat(F.concat_ws("", pairs), last, end))
    return (F.when(entity.rlike(r"\p{IsCyrillic}"), built("бвгдзклмнпрст", "аеиоу", "ин", "ина"))
            .when(entity.rlike(r"\p{IsGreek}"), built("βγδζκλμνπρστ", "αειου", "ος", "η"))
            .otherwise(built("bdfgklmnprstv", "aeiou", "en", "a")))


def _in_shape(kind: Column, found: Column, name: Column) -> Column:
    """A surrogate in normal form, written like the text it replaces."""
    walked = F.aggregate(F.split(found, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("s")), lambda a, c: F.when(
        c.rlike(r"\d"), F.struct((a["i"] + 1).alias("i"), F.concat(a["s"], F.substring(name, a["i"], F.lit(1))).alias("s"))
    ).otherwise(F.struct(a["i"].alias("i"), F.concat(a["s"], c).alias("s"))))["s"]
    return (F.when(kind.isin("card", "phone", "ssn"), walked)
            .when((kind == "email") & (found == F.upper(found)), F.upper(name)).otherwise(name))


def surrogates(entities: DataFrame, key: str, rounds: int = 64) -> DataFrame:
    """``entities`` (kind, entity), distinct -> with ``name``, the surrogate:
    no two of a kind alike, none an entity of the corpus."""
    fixed = None
    open_rows = cut(entities.withColumn("attempt", F.lit(0)))
    for _ in range(rounds):
        drawn = cut(draw(open_rows, key))        # else join keys would be worked out anew below every filter
        taken = entities.select("kind", F.col("entity").alias("name")).withColumn("real", F.lit(True))
        drawn = drawn.join(taken, ["kind", "name"], "left")
        if fixed is not None:
            drawn = drawn.join(fixed.select("kind", "name", F.lit(True).alias("used")), ["kind", "name"], "left")
        else:
            drawn = drawn.withColumn("used", F.lit(None).cast("boolean"))
        drawn = cut(drawn)
        first = drawn.where("real IS NULL AND used IS NULL").groupBy("kind", "name").agg(F.min("entity").alias("entity"))
        good = drawn.join(first, ["kind", "name", "entity"], "left_semi").select("kind", "entity", "name")
        fixed = cut(good if fixed is None else fixed.unionByName(good))
        open_rows = cut(drawn.join(first, ["kind", "name", "entity"], "left_anti").select(
            "kind", "entity", (F.col("attempt") + 1).alias("attempt")))
        if open_rows.isEmpty():
            return fixed
    raise ValueError(f"no distinct surrogates left after {rounds} attempts; the first: {open_rows.first()}")


def replace_private(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text with surrogates, n_entities, kinds
    (sorted, joined by commas).

    Defined cases: a null text stays null with no entities; empty texts and
    texts without entities stay as they are; rows that repeat an id or a text
    are replaced alike; an empty table gives an empty result.  The same key
    and table give the same surrogates.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    # Words of a document's titled names are entities wherever they stand in it.
    titled = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(TITLED), F.lit(1)), lambda m: F.split(m, " ")))
    base = base.withColumn("bare", F.when(F.col("text").rlike(rf"\b(?:{TITLE})\.? \p{{Lu}}"),
                                          F.array_distinct(F.filter(titled, lambda w: ~w.rlike(INITIAL)))))
    word = F.concat(F.lit("(?:"), F.array_join("bare", "|"), F.lit(")"))
    # Only texts with a titled name have a pattern of their own; the others share one, compiled once.
    own = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}_])"), word, F.lit("(?: "), word, F.lit(r")*(?![\p{L}\p{N}_])"))
    named_here = F.size("bare") > 0

    def kinds(matches: Column) -> Column:
        return F.transform(matches, lambda m: F.struct(m.alias("found"), kind_of(m).alias("kind")))

    found = F.when(named_here, kinds(F.regexp_extract_all("text", own, F.lit(0)))).otherwise(
        kinds(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    pieces = F.when(named_here, F.split("text", own)).otherwise(F.split("text", ANY))
    rows = base.withColumn("found", found)
    any_found = F.coalesce(F.exists("found", lambda m: m["kind"].isNotNull()), F.lit(False))
    clean = rows.where(~any_found).select("doc_id", "text", F.lit(0).alias("n_entities"), F.lit("").alias("kinds"))
    # Cut here: the texts with entities are looked through once, and kept as matches and what lies between them.
    hit = cut(rows.where(any_found).select("doc_id", F.sha2("text", 256).alias("digest"), "found", pieces.alias("pieces")))

    # Names are entities by word: family and given names are known on their own.
    gender = F.when(F.regexp_extract("before", rf"(?:\b(?:{FEMALE}))\.? $", 0) != "", "female").otherwise("male")
    spots = cut(hit.dropDuplicates(["digest"]).select("digest", F.posexplode("found").alias("pos", "m"), "pieces")
                .select("digest", "pos", F.col("m.found").alias("found"), F.col("m.kind").alias("kind"),
                        F.get("pieces", F.col("pos")).alias("before"))
                .where("kind IS NOT NULL").withColumn("gender", F.when(F.col("kind") == "name", gender))
                .withColumn("titled", F.col("before").rlike(rf"\b(?:{TITLE})\.? $")).drop("before"))
    words = F.split("found", " ")
    as_name = F.transform(words, lambda w, i: F.struct(
        F.when(w.rlike(INITIAL), "initial").when(i == F.size(words) - 1, "family").otherwise(F.concat(F.lit("given "), F.col("gender"))).alias("kind"), w.alias("entity")))
    one = F.array(F.struct(F.col("kind").alias("kind"), normal_form(F.col("kind"), F.col("found")).alias("entity")))
    parts = spots.select("digest", "pos", "found", "titled", F.posexplode(F.when(F.col("kind") == "name", as_name).otherwise(one)).alias("word", "e"))
    # A bare mention is what the document's titled name says that the word is.
    parts = parts.select("digest", "pos", "found", "titled", "word", "e.kind", "e.entity")
    is_name = F.col("kind").rlike("^(given|family)")
    said = F.min(F.when(F.col("titled") & is_name, F.col("kind"))).over(Window.partitionBy("digest", "entity"))
    parts = parts.withColumn("kind", F.when(is_name & ~F.col("titled"), F.coalesce(said, "kind")).otherwise(F.col("kind")))
    parts = cut(parts.drop("titled")).withColumn(
        "at", F.struct("kind", "entity"))
    entities = cut(parts.select("kind", "entity").distinct())
    names = surrogates(entities.where("kind != 'initial'"), key)
    # Initials are too few to stay different.
    names = names.unionByName(draw(entities.where("kind = 'initial'").withColumn("attempt", F.lit(0)), key).drop("attempt"))
    named = spread_join(parts.drop("kind", "entity"), names.select(F.struct("kind", "entity").alias("at"), "name"), "at", "digest")
    written = named.select("digest", "pos", "word", F.col("at.kind").alias("kind"),
                           _in_shape(F.col("at.kind"), F.col("found"), F.col("name")).alias("new"))
    joined = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("word", "new"))), lambda x: x["new"]))
    spot = written.groupBy("digest", "pos").agg(joined.alias("new"), F.min("kind").alias("kind"))
    by_text = cut(spot.groupBy("digest").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("new"), F.count("*").cast("int").alias("n_entities"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("kind").rlike("^(given|family|initial)"), "name").otherwise(F.col("kind"))))).alias("kinds")))

    whole = spread_join(hit, by_text, "digest", "doc_id")
    whole = whole.withColumn("said", F.transform("found", lambda m, i: F.coalesce(F.try_element_at("new", i), m["found"])))
    text = F.concat_ws("", F.transform("pieces", lambda p, i: F.concat(p, F.coalesce(F.get("said", i), F.lit("")))))
    return clean.unionByName(whole.select("doc_id", text.alias("text"), "n_entities", "kinds"))
