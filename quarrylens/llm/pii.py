"""Personal data replaced by keyed surrogates, in native expressions.

One alternation of patterns cuts a text into entities and the rest. An entity's
canonical form (lower case, digits only for numbers) is what it refers to: all
its mentions in the corpus get one surrogate, drawn by SHA-256 from the secret
key, the type and the canonical form. Every letter becomes a letter of its
script and case, every digit a digit, and what stands between stays, so a phone
number keeps its grouping and a shouted address its capitals. Names after a
title get names of that title's gender in their own script.

Collision checks: surrogates of one type must differ from each other and from
every entity of the corpus. Of several owners the least keeps its surrogate;
the others, and those that hit an entity, draw again with a higher attempt,
until no clash is left. Only the table of distinct entities takes part; texts
without entities are neither shuffled nor rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens import session

KEY = "rotate-me"

#: Attempts from which surrogates grow longer.
LONGER = 16

# Patterns by type; earlier ones win where several fit.
_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
# The first two conditions only spare most positions the label, which is sought backwards.
SECRET = (
    r"(?<=[=: \"'])(?=[A-Za-z0-9_+/=-]{12})(?<=(?i:token|secret|api[_-]?key|apikey|passwd|password|access[_-]?key)[\"']?[ ]{0,3}[=:][ ]{0,3}[\"']?)(?=[_+/=-]*[A-Za-z0-9])[A-Za-z0-9_+/=-]{12,}"
    r"|(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])"
)
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
CARD = (
    r"(?<![\d.])\d{13,19}(?!\d)|(?<![\d-])\d{4}(?:-\d{4}){2}-\d{1,7}(?![\d-])"
    r"|(?<![\d-])\d{4}(?: \d{4}){2} \d{1,7}(?!\d)|(?<![\d-])\d{4}[ -]\d{6}[ -]\d{5}(?!\d)"
)
IPV4 = rf"(?<![\d.]){_BYTE}(?:\.{_BYTE}){{3}}(?!\.?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = (
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<!\d)\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])"
)
# Titles by gender.
FEMALE = r"Mrs|MRS|Ms|Miss|MISS|Frau|FRAU|Mme|Madame|MADAME|Mademoiselle|Señora|SEÑORA|Señorita|Sra|Srta|Госпожа|госпожа|ГОСПОЖА|г-жа"
MALE = r"Mr|MR|Herr|HERR|Monsieur|MONSIEUR|Señor|SEÑOR|Sr|Господин|господин|ГОСПОДИН|г-н"
EITHER = r"Dr|Prof|PROF"
# In capitals these are titles only before capitals (MS SMITH, but MS Word).
LOUD_FEMALE, LOUD_MALE, LOUD_EITHER = r"(?:MS|MME|SRA|SRTA)(?=\.? \p{Lu}{2})", r"SR(?=\.? \p{Lu}{2})", r"DR(?=\.? \p{Lu}{2})"
TITLE = rf"(?:{FEMALE}|{MALE}|{EITHER}|{LOUD_FEMALE}|{LOUD_MALE}|{LOUD_EITHER})\.? "
# Small words inside names, and capitalized words that end one.
PARTICLE = (
    r"(?:van|von|vom|zu|zum|zur|de|der|den|del|della|di|da|das|dos|du|des|la|le|ten|ter|bin|ibn|al|el|y|e|af|av|"
    r"VAN|VON|VOM|ZU|DE|DER|DEN|DEL|DI|DA|DU|LA|LE|TEN|TER|BIN|IBN|AL|EL)"
)
NO_NAME = (
    r"(?:I|And|AND|Or|OR|The|THE|Is|IS|Was|WAS|Are|ARE|Has|HAS|Had|HAD|Will|WILL|At|AT|In|IN|Of|OF|On|ON|To|TO|For|FOR|From|FROM|"
    r"With|WITH|And|He|HE|She|SHE|They|THEY|We|WE|You|YOU|It|IT|Who|WHO|Said|SAID|Und|UND|Et|ET|Ist|IST|Hat|HAT)(?![\p{L}\p{M}'’-])"
)
_WORD = (
    r"(?:\p{Lu}\.(?![\p{L}\p{M}])|(?:(?:[dlDL]|[Aa]l|[Ee]l)['’-])?\p{Lu}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*)"
)
#: Any number of parts: inner capitals, hyphens, apostrophes, initials, particles, all capitals.
NAME = rf"(?:{PARTICLE} )*{_WORD}(?: (?!{NO_NAME})(?:{PARTICLE} )*{_WORD})*"
# the first letters of titles come first, which spares most positions the rest
PERSON = rf"(?=[DFHMPSГг])(?<![\p{{L}}\p{{M}}])(?:{TITLE})+{NAME}"
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IBAN, CARD, IPV4, SSN, PHONE, PERSON))

# Given names by script and gender, and surnames by script.
NAMES = {
    "latin": {
        "f": "Alma Berta Clara Delia Edith Flora Greta Hanna Irma Julia Klara Lydia Marta Nora Olga Petra Rosa Selma Thea Vera".split(),
        "m": "Arno Bruno Carl Dario Egon Felix Georg Hugo Ivan Jonas Karl Leo Mario Nils Oskar Paul Remo Simon Theo Viktor".split(),
        "s": "Adler Brandt Castel Duval Ebert Ferro Garnier Holm Iver Jansen Keller Lindt Moreau Nolde Olsen Pardo Quint Roth Sorel Varga".split(),
    },
    "cyrillic": {
        "f": "Алла Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Раиса Софья Тамара Юлия".split(),
        "m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Степан Юрий".split(),
        "s": "Белов Волков Громов Дроздов Ершов Жуков Зимин Котов Лосев Орлов Панин Рогов Соболев Титов Чернов".split(),
    },
}


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _kind(e: Column) -> Column:
    fits = lambda p: e.rlike(f"^(?:{p})$")
    return (
        F.when(e.contains("@"), F.lit("email")).when(fits(PERSON), F.lit("person"))
        .when(fits(IBAN), F.lit("iban")).when(fits(IPV4), F.lit("ipv4")).when(fits(SSN), F.lit("ssn"))
        .when(fits(CARD), F.lit("card")).when(fits(PHONE), F.lit("phone")).otherwise(F.lit("secret"))
    )


def _canonical(kind: Column, e: Column) -> Column:
    """A person's is its title's gender (f, m or x), a colon and the name."""
    says = lambda female, loud: e.rlike(rf"^(?:{TITLE})*(?:{female}|{loud})\.? ")
    gender = F.when(says(FEMALE, LOUD_FEMALE), F.lit("f")).when(says(MALE, LOUD_MALE), F.lit("m")).otherwise(F.lit("x"))
    name = F.translate(F.lower(F.regexp_replace(e, f"^(?:{TITLE})+", "")), "’", "'")
    return (
        F.when(kind == "person", F.concat(gender, F.lit(":"), name))
        .when(kind.isin("card", "phone", "ssn"), F.regexp_replace(e, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(e, " ", "")).when(kind == "ipv4", e).otherwise(F.lower(e))
    )


def one_person_each(found: DataFrame) -> DataFrame:
    """`found` with the persons named without a gender (Dr.) merged with those of
    the same name and one gender; where a name has both, it stays apart."""
    people = session.cut_lineage(found.where("kind = 'person'").select("canon").distinct())
    name = F.substr("canon", F.lit(3))
    genders = F.collect_set(F.when(~F.col("canon").startswith("x:"), F.left("canon", F.lit(1))))
    by_name = people.groupBy(name.alias("name")).agg(genders.alias("g"), F.max(F.col("canon").startswith("x:")).alias("bare"))
    merged = by_name.where((F.size("g") == 1) & F.col("bare")).select(
        F.concat(F.lit("x:"), "name").alias("canon"), F.concat(F.col("g")[0], F.lit(":"), "name").alias("as_canon")
    )
    merged = merged.withColumn("kind", F.lit("person"))
    joined = found.join(merged, ["kind", "canon"], "left")
    return joined.withColumn("canon", F.coalesce("as_canon", "canon")).select(*found.columns)


def _draw(key: str, *parts: str) -> str:
    """SQL of a number below 2^32, keyed by the secret and the parts."""
    joined = ", ".join(("'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'", *[f"cast({p} AS string)" for p in parts]))
    return f"cast(conv(substr(sha2(concat_ws('|', {joined}), 256), 1, 8), 16, 10) AS bigint)"


def _surrogate(key: str) -> Column:
    """Canonical surrogate of (kind, canon, attempt)."""
    r = _draw(key, "kind", "canon", "attempt", "i")
    letter = f"chr(97 + {r} % 26)"
    spelled = (
        "array_join(transform(split(canon, ''), (c, i) -> CASE "
        f"WHEN c RLIKE '[0-9]' THEN cast({r} % 10 AS string) WHEN c RLIKE '[a-f]' AND kind = 'secret' AND canon RLIKE '^[0-9a-f]+$' "
        f"THEN substr('abcdef', cast({r} % 6 AS int) + 1, 1) WHEN c RLIKE '[a-z]' THEN {letter} WHEN c RLIKE '[A-Z]' THEN upper({letter}) ELSE c END), '')"
    )
    # no free value of this length: longer and longer ones
    more = f"cast({r} % 10 AS string)"
    more = f"CASE WHEN kind IN ('email', 'secret') THEN {letter} ELSE {more} END"
    longer = f"CASE WHEN attempt < {LONGER} THEN '' ELSE array_join(transform(sequence(1000, 1000 + attempt - {LONGER}), i -> {more}), '') END"
    ip = f"array_join(transform(sequence(0, 3), i -> cast(1 + {r} % 254 AS string)), '.')"
    kept_end = r"regexp_extract(canon, '(\\.[a-z]{2,})$', 1)"
    mail = f"concat(left({spelled}, length(canon) - length({kept_end})), {kept_end})"

    def name(script: str) -> str:
        pool = lambda k: "array(" + ", ".join(f"'{n}'" for n in NAMES[script][k]) + ")"
        pick = lambda names, i: f"get({names}, cast({_draw(key, 'kind', 'canon', 'attempt', i)} % size({names}) AS int))"
        first = f"CASE left(canon, 1) WHEN 'f' THEN {pick(pool('f'), '0')} WHEN 'm' THEN {pick(pool('m'), '0')} ELSE {pick(f'concat({pool('f')}, {pool('m')})', '0')} END"
        low, n = ("97", 26) if script == "latin" else ("1072", 32)
        glyph = f"chr({low} + {r} % {n})" if script == "latin" else f"substr('абвгдежзийклмнопрстуфхцчшщъыьэюя', cast({r} % {n} AS int) + 1, 1)"
        # where the pools are used up, surnames of their own are spelled
        last = f"CASE WHEN attempt < 4 THEN {pick(pool('s'), '1')} ELSE initcap(array_join(transform(sequence(2, 9), i -> {glyph}), '')) END"
        if script == "cyrillic":
            last = f"concat({last}, CASE left(canon, 1) WHEN 'f' THEN 'а' ELSE '' END)"
        return f"CASE WHEN canon RLIKE '[ -]' THEN concat({first}, ' ', {last}) ELSE {last} END"

    person = f"concat(left(canon, 2), CASE WHEN canon RLIKE '[а-яё]' THEN {name('cyrillic')} ELSE {name('latin')} END)"
    return F.expr(f"CASE kind WHEN 'ipv4' THEN {ip} WHEN 'email' THEN concat({mail}, {longer}) WHEN 'person' THEN {person} ELSE concat({spelled}, {longer}) END")


def _shown(e: str, kind: str, canon: str) -> Column:
    """The surrogate in the dress of the mention: its case and separators."""
    drawn = f"substr({canon}, length(regexp_replace(substr({e}, 1, i + 1), '[^A-Za-z0-9]', '')), 1)"
    digits = f"array_join(transform(split({e}, ''), (c, i) -> CASE WHEN c RLIKE '[A-Za-z0-9]' THEN {drawn} ELSE c END), '')"
    cased = (
        f"array_join(transform(split({e}, ''), (c, i) -> CASE WHEN c RLIKE '[A-Z]' THEN upper(substr({canon}, i + 1, 1)) "
        f"WHEN c RLIKE '[a-z0-9]' THEN substr({canon}, i + 1, 1) ELSE c END), '')"
    )
    title = f"regexp_extract({e}, '^(?:{TITLE})+', 0)".replace("\\", "\\\\")
    own = f"substr({e}, length({title}) + 1)"
    loud = f"{own} = upper({own}) AND {own} RLIKE '[\\\\p{{L}}]{{2}}'"
    person = f"concat({title}, CASE WHEN {loud} THEN upper(substr({canon}, 3)) ELSE substr({canon}, 3) END)"
    digits = f"concat({digits}, substr({canon}, length(regexp_replace({e}, '[^A-Za-z0-9]', '')) + 1))"
    cased = f"concat({cased}, substr({canon}, length({e}) + 1))"
    return F.expr(
        f"CASE {kind} WHEN 'person' THEN {person} WHEN 'ipv4' THEN {canon} "
        f"WHEN 'email' THEN {cased} WHEN 'secret' THEN {cased} ELSE {digits} END"
    )


def surrogates(found: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canon, surrogate for each distinct (kind, canon) of `found`."""
    # what is seen of a surrogate: not a person's gender or case
    face = lambda c: F.when(F.col("kind") == "person", F.lower(F.substr(c, F.lit(3)))).otherwise(F.col(c))
    known = session.cut_lineage(found.select("kind", "canon").distinct())
    todo, done = known.withColumn("attempt", F.lit(0)), None
    while True:
        drawn = session.cut_lineage(todo.withColumn("surrogate", _surrogate(key)).withColumn("face", face("surrogate")))
        taken = known.select("kind", face("canon").alias("face"))
        if done is not None:
            taken = taken.union(done.select("kind", face("surrogate").alias("face")))
        first = drawn.groupBy("kind", "face").agg(F.min(F.struct("canon", "surrogate")).alias("least"))
        won = first.join(taken.distinct(), ["kind", "face"], "left_anti").select("kind", "least.canon", "least.surrogate")
        done = session.cut_lineage(won if done is None else done.union(won))
        todo = session.cut_lineage(
            drawn.join(done, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        )
        if todo.isEmpty():
            return done


def replace_personal_data(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text, n_entities: one row per row of `docs`, all entities replaced.

    Null texts stay null, texts without entities stay as they are (0 entities).
    Rows that repeat get the same result again; a null doc_id changes nothing.
    The same key gives the same surrogates over the same table. A person without
    a title before the name isn't recognised.
    """
    d = docs.select(docs["doc_id"], docs["text"]).withColumn("ents", entities(F.coalesce("text", F.lit(""))))
    # written once: the patterns cost far more than the copy
    d = session.cut_lineage(d.withColumn("row_no", F.monotonically_increasing_id()))
    clean = d.where(F.size("ents") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    hit = d.where(F.size("ents") > 0)
    e = hit.select("row_no", F.posexplode("ents").alias("pos", "e")).withColumn("kind", _kind(F.col("e")))
    e = session.cut_lineage(one_person_each(session.cut_lineage(e.withColumn("canon", _canonical(F.col("kind"), F.col("e"))))))
    shown = e.join(surrogates(e, key), ["kind", "canon"]).select("row_no", "pos", _shown("e", "kind", "surrogate").alias("r"))
    by_row = shown.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("pos", "r"))).alias("rs"))
    rest = F.split("text", PATTERN)
    h = hit.join(by_row, "row_no").withColumn("rest", rest).withColumn("new", F.col("rs.r"))
    text = F.array_join(F.flatten(F.transform("rest", lambda s, i: F.array(s, F.coalesce(F.get("new", i), F.lit(""))))), "")
    return clean.union(h.select("doc_id", text.alias("text"), F.size("new").cast("long").alias("n_entities")))
