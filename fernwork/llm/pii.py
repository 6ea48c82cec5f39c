"""PII surrogates: personal data is replaced by keyed values of the same kind, in DataFrame operations only.

Detected are e-mail addresses, phone numbers, IPv4 addresses, payment card
numbers, social security numbers, IBANs, secret tokens and names (a title or a known given name with the
family name after it, also with hyphens, apostrophes, inner capitals or von, de and the like; Latin, Cyrillic and Greek script).

An entity is its kind and its canonical form (addresses in lower case, numbers
without separators, names as one name whether written with a title or not), so
that mentions of one entity get one surrogate everywhere (coreference).
Surrogates come from SHA-256 of a secret key, the entity and an attempt number:
digits for digits and letters for letters of the same case, in the mention's
own format; given names of the same gender and script and family names of the
same script, where a family name has one surrogate with any title or given name; mail addresses under reserved example domains; IP addresses in
198.18.0.0/15, or in larger ranges where that is full; cards with a valid check digit.

Collision check: surrogates are compared over all entities of a kind. Each kind's space
of values grows with the attempt (longer numbers, names and ranges). An entity
whose surrogate is a real entity, or is also that of an entity before it, makes
its next attempt, until all are distinct.

Null texts stay null; texts without personal data are unchanged; empty input
gives empty output. Repeated rows are replaced alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, saved, table

KEY = "change-me"

# Given names by script and gender; family names are built from syllables of the script.
MALE = {
    "latin": ["James", "John", "Robert", "Michael", "David", "Thomas", "Daniel", "Peter", "Paul", "Mark", "Jean", "Pierre", "Hans", "Klaus", "Carlos", "Miguel", "Antonio", "Luis"],
    "cyrillic": ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей", "Михаил"],
    "greek": ["Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Γιάννης", "Παύλος"],
}
FEMALE = {
    "latin": ["Mary", "Anna", "Linda", "Susan", "Karen", "Laura", "Emma", "Julia", "Sarah", "Alice", "Marie", "Claire", "Petra", "Heike", "Carmen", "Lucia", "Elena", "Sofia"],
    "cyrillic": ["Мария", "Анна", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"],
    "greek": ["Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Άννα", "Ειρήνη"],
}
MALE_TITLES = ["Mr", "Sir", "Monsieur", "Herr", "Señor", "господин", "κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madame", "Frau", "Señora", "госпожа", "κυρία"]
# Names by which mentions are found, besides those above; words that are common in other uses are left out.
KNOWN_MALE = """
Aaron Abdul Abdullah Adam Adrian Ahmad Ahmed Alan Albert Alejandro Alessandro Alex Alexander Alexandre Alfred Ali Amir Amit Andrea Andreas Andrei Andrew André Andrés Anthony Antoine Anton Arjun Arthur Arun
Axel Benjamin Bernard Bernd Björn Brandon Brian Bruce Bruno Carl Charles Christian Christoph Christopher Claude Craig Cristian Dennis Denis Deepak Derek Diego Dieter Dirk Dmitri Donald Douglas Dylan Edgar Eduardo Edward Emil
Emmanuel Enrique Erik Eric Ernst Ethan Eugene Fabian Federico Felix Fernando Filip Francesco Francis Francisco François Frank Franz Fred Frederick Friedrich Gabriel Gary Geoffrey George Georg Georges Gerald Gerard Gerhard Giovanni
Giuseppe Gordon Gregory Guido Guillaume Gustav Guy Günter Günther Hamid Harold Harry Hassan Heinrich Heinz Helmut Henri Henry Herbert Hermann Hiroshi Howard Hugo Hussein Ian Ibrahim Ignacio Igor Isaac Ivan Jack Jacob Jacques Jakob
Jan Jason Javier Jeffrey Jens Jeremy Jesús Joachim Johann Johannes Jonas Jonathan Jorge José Joseph Joshua Juan Julian Julien Jürgen Karim Karl Keith Kenji Kenneth Kevin Khalid Konrad Kurt Kyle Larry Lars Laurent Lawrence Leo Leon
Leonard Liam Logan Lorenzo Louis Luca Lucas Ludwig Lukas Luke Manfred Manuel Marc Marcel Marco Marcus Mario Markus Martin Matteo Matthew Matthias Maurice Max Maximilian Mehmet Mohamed Mohammad Mohammed Muhammad Mustafa Nathan
Nicholas Nicolas Nikolai Nils Noah Norbert Oliver Olivier Omar Oscar Oskar Otto Pablo Pascal Patrick Pedro Philip Philipp Philippe Rafael Rahul Rainer Rajesh Ralf Ralph Ramón Raymond René Ricardo Richard Roberto Roger Roland Rolf
Ronald Rudolf Russell Ryan Salvador Samuel Sanjay Santiago Scott Sean Sebastian Sergei Sergio Simon Stanley Stefan Stephan Stephen Steve Steven Stuart Sven Takashi Theodor Theodore Thierry Tim Timothy Tobias Tom Tomás Udo Ulrich
Uwe Victor Viktor Vijay Vincent Vladimir Walter Werner Wilhelm William Wolfgang Xavier Yusuf Yves Zachary Álvaro Ángel Óscar
Александр Алексей Анатолий Антон Артём Борис Вадим Валерий Василий Виктор Виталий Владимир Вячеслав Геннадий Георгий Григорий Данил Денис Евгений Егор Игорь Илья Кирилл Константин Леонид Максим Никита Олег Павел Пётр Роман Руслан
Станислав Степан Тимур Фёдор Юрий Ярослав
Αλέξανδρος Ανδρέας Αντώνης Βασίλης Γεώργιος Ευάγγελος Θανάσης Ιωάννης Κωνσταντίνος Μανώλης Μιχάλης Νικόλαος Παναγιώτης Πέτρος Σπύρος Στέφανος Χρήστος
""".split()
KNOWN_FEMALE = """
Abigail Adriana Aisha Alexandra Alicia Alina Amanda Amélie Amy Ana Andrée Angela Angelika Anita Anja Anne Annette Annika Antonia Aurélie Barbara Beatrice Beatriz Brenda Brigitte Camila Camille Carla Carol Carolina Caroline Catherine
Cecilia Chantal Charlotte Chiara Christiane Christina Christine Cindy Clara Claudia Cristina Cynthia Danielle Deborah Denise Diana Dolores Donna Doris Dorothy Edith Eleanor Elisabeth Elizabeth Ella Ellen Emily Emilie Erika Esther
Eva Evelyn Fatima Florence Francesca Françoise Frida Gabriela Gabriele Gertrud Gisela Giulia Gloria Greta Hannah Hanna Helen Helena Helga Hélène Ines Inge Ingrid Irene Isabel Isabella Isabelle Jacqueline Jana Jane Janet Jennifer
Jessica Jin Joan Johanna Josephine Joyce Juana Judith Julie Juliette Karin Katharina Katherine Kathleen Kathrin Katja Katrin Kelly Kimberly Lara Lea Leila Lena Leonie Lisa Louise Lucie Lucy Luisa Lydia Léa Madeleine Magdalena
Manuela Margaret Margarita Margot Maria Mariana Marianne Marina Marion Marlene Marta Martha Martina María Mathilde Megan Melanie Melissa Mercedes Mia Michelle Mona Monica Monika Monique Nadia Nancy Natalia Natalie Nathalie Nicole
Nina Noor Nora Olga Olivia Pamela Patricia Paula Pauline Pilar Priya Rachel Rebecca Regina Renate Rita Rosa Ruth Sabine Samantha Sandra Sara Sharon Shirley Silvia Simone Sonia Sonja Sophia Sophie Stefanie Stephanie Susanne Svetlana
Sylvia Sylvie Tanja Tatiana Teresa Theresa Ursula Ute Valentina Valeria Valérie Vanessa Vera Veronica Victoria Virginia Véronique Yasmin Yuki Yvonne Zainab Zoe Zoé
Александра Алина Алла Анастасия Валентина Валерия Вера Виктория Галина Дарья Евгения Екатерина Елизавета Зоя Инна Ксения Лариса Людмила Маргарита Марина Надежда Нина Оксана Полина Раиса София Тамара Юлия Яна
Αγγελική Αθηνά Αικατερίνη Αναστασία Βασιλική Γεωργία Δήμητρα Ευαγγελία Ιωάννα Κωνσταντίνα Παναγιώτα Χριστίνα
""".split()
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "tu", "va", "ken", "lor", "mar", "ten", "vin"],
    "cyrillic": ["ба", "де", "фи", "го", "лу", "ма", "не", "ри", "со", "ту", "ва", "кен", "лор", "мар", "тен", "вин"],
    "greek": ["βα", "δε", "φι", "γο", "λου", "μα", "νε", "ρι", "σο", "του", "βι", "κεν", "λορ", "μαρ", "τεν", "πιν"],
}



def _any_of(words: set[str]) -> str:
    """A pattern of just these words, common beginnings written once; longer words are tried first."""
    heads: dict[str, set[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], set()).add(w[1:])
    tails = [c + _any_of(rest) for c, rest in sorted(heads.items())]
    return ("(?:" + "|".join(tails) + ")" + ("?" if "" in words else "")) if tails else ""


_MALE = [n for names in MALE.values() for n in names] + KNOWN_MALE
_FEMALE = [n for names in FEMALE.values() for n in names] + KNOWN_FEMALE
_GIVEN = _any_of({*_MALE, *_FEMALE})
_TITLES = "|".join(MALE_TITLES + FEMALE_TITLES)
#: One pattern for all kinds, tried in this order at each place; each kind is told apart again by its own form.
EMAIL = r"[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}"
TOKEN = r"(?:[0-9a-f]{40,64}|[0-9A-F]{40,64}|[0-9a-f]{32}|[0-9A-F]{32}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36})"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
IP = r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CARD = r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})"
# McDonald, O'Brien, Smith-Jones, van der Berg
_PART = r"(?:\p{Lu}['’])?(?:\p{Lu}\p{Ll}+)+"
FAMILY = rf"(?:(?:van|von|zu|der|den|de|la|del|di|da|bin|ibn) ){{0,3}}{_PART}(?:-{_PART})*"
FORENAME = rf"{_GIVEN}(?:-{_GIVEN})?(?: \p{{Lu}}\.)?"
NAME = rf"(?:(?:{_TITLES})\.? (?:{FORENAME} )?{FAMILY}|{FORENAME} {FAMILY})"
_EDGE = r"(?<![\p{L}\p{N}_])"
_END = r"(?![\p{L}\p{N}_])"
ANY = (
    rf"(?<![\p{{L}}\p{{N}}_@.%+-])(?:{EMAIL}){_END}|{_EDGE}(?:{TOKEN}){_END}|{_EDGE}(?:{IBAN}){_END}|(?<![\p{{L}}\p{{N}}_-])(?:{SSN})(?![\p{{L}}\p{{N}}_]|-[0-9])|(?<![\p{{L}}\p{{N}}_.])(?:{IP})(?![\p{{L}}\p{{N}}_]|\.[0-9])"
    rf"|(?<![\p{{L}}\p{{N}}_+.-])(?:{CARD})(?![\p{{L}}\p{{N}}_]|-[0-9])|(?<![\p{{L}}\p{{N}}_.-])(?:{PHONE})(?![\p{{L}}\p{{N}}_]|-[0-9])|{_EDGE}(?:{NAME}){_END}"
)
#: Without any of these there is no mention.
SIGN = rf"@|[0-9]{{2}}|[0-9]\.[0-9]|AKIA|ghp_|[0-9a-fA-F]{{32}}|(?<!\p{{L}})(?:(?:{_TITLES})[. ]|{_GIVEN}[ -])"


def _hash_digit(seed: Column, i: Column, base: int | Column) -> Column:
    """The i-th of many keyed numbers below ``base``: eight hex digits of a hash that is renewed every eight places."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(seed, F.floor(i / 8).cast("string")), 256), F.pmod(i, F.lit(8)).cast("int") * 8 + 1, F.lit(8)), 16, 10).cast("bigint"), F.lit(base) if isinstance(base, int) else base)


def _filled(shape: Column, seed: Column) -> Column:
    """Digits for digits, letters for letters of the same case, all else kept."""
    char = lambda c, i: (
        F.when(c.rlike("[0-9]"), _hash_digit(seed, i, 10).cast("string"))
        .when(c.rlike("[a-z]"), F.char(F.lit(97) + _hash_digit(seed, i, 26)))
        .when(c.rlike("[A-Z]"), F.char(F.lit(65) + _hash_digit(seed, i, 26)))
        .when(c.rlike(r"\p{L}"), F.char(F.lit(97) + _hash_digit(seed, i, 26)))
        .otherwise(c)
    )
    return F.array_join(F.transform(F.split(shape, ""), char), "")


def _hexed(shape: Column, seed: Column) -> Column:
    char = lambda c, i: F.substring(F.lit("0123456789abcdef"), _hash_digit(seed, i, 16).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.split(shape, ""), char), "")


def _luhn(body: Column) -> Column:
    """The check digit of a row of digits."""
    digits = F.transform(F.reverse(F.split(body, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _pick(values: list[str], seed: Column, i: int | Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), _hash_digit(seed, F.lit(i) if isinstance(i, int) else i, len(values)).cast("int") + 1)


def _family(script: str, seed: Column, attempt: Column) -> Column:
    """Four syllables, one more with each attempt, and an ending: 16^4 * 10 family names a script at first."""
    more = F.transform(F.sequence(F.lit(1), F.lit(4) + attempt), lambda i: _pick(SYLLABLES[script], seed, i))
    return F.initcap(F.concat(F.array_join(more, ""), _pick(SYLLABLES[script][:10], seed, 0)))


def _given(values: list[str], seed: Column, attempt: Column) -> Column:
    """One given name, from every fourth attempt on one more, joined by hyphens."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / 4).cast("int")), lambda i: _pick(values, seed, i)), "-")


def _address(seed: Column, attempt: Column) -> Column:
    """198.18.0.0/15, then 10.0.0.0/8, 240.0.0.0/4 and at last all addresses."""
    n = lambda i, base: _hash_digit(seed, F.lit(i), base)
    first = F.when(attempt == 0, F.lit(198)).when(attempt == 1, F.lit(10)).when(attempt < 6, F.lit(240) + n(0, 16)).otherwise(n(0, 256))
    second = F.when(attempt == 0, F.lit(18) + n(3, 2)).otherwise(n(3, 256))
    return F.concat_ws(".", *[x.cast("string") for x in (first, second, n(1, 256), n(2, 256))])


def kind_of(mention: Column) -> Column:
    whole = lambda p: mention.rlike(f"^(?:{p})$")
    return (
        F.when(mention.contains("@"), "email").when(whole(TOKEN), "token").when(whole(SSN), "ssn").when(whole(IP), "ip").when(whole(CARD), "card").when(mention.rlike("^[A-Z]{2}[0-9]{2}"), "iban")
        .when(mention.rlike("^[+(0-9]"), "phone").otherwise("name")
    )


def canonical(mention: Column, kind: Column) -> Column:
    digits = F.regexp_replace(mention, "[^0-9]", "")
    bare = F.regexp_replace(mention, rf"^(?:{_TITLES})\.? ", "")
    return (
        F.when((kind == "email") | mention.rlike("^[0-9A-F]{32,}$") & (kind == "token"), F.lower(mention)).when(kind.isin("card", "ssn"), digits).when(kind == "phone", F.when(digits.rlike("^1[0-9]{10}$"), F.substring(digits, 2, 10)).otherwise(digits))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(kind == "name", bare).otherwise(mention)
    )


def script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def gender_of(mention: Column) -> Column:
    """From the title, else from the given name; '' if neither tells."""
    male, female = _any_of({*MALE_TITLES, *_MALE}), _any_of({*FEMALE_TITLES, *_FEMALE})
    return F.when(mention.rlike(rf"^{female}(?:\. |[ -])"), "f").when(mention.rlike(rf"^{male}(?:\. |[ -])"), "m").otherwise("")


def family_of(form: Column) -> Column:
    """The family name of a name without title: all after the given name, if it begins with one."""
    rest = F.regexp_extract(form, rf"^{FORENAME} (.+)$", 1)
    return F.when(rest != "", rest).otherwise(form)


def surrogate(kind: Column, form: Column, gender: Column, key: str, attempt: Column, family: Column) -> Column:
    """The canonical surrogate of an entity; ``family`` is the surrogate of a name's family name. Each kind's values grow in number with the attempt."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, form, attempt.cast("string")), 256)
    local = F.substring_index(form, "@", 1)
    script = script_of(form)
    given = last = None
    for s in SYLLABLES:
        given = (F.when if given is None else given.when)((script == s) & (gender == "f"), _given(FEMALE[s], seed, attempt)).when(script == s, _given(MALE[s], seed, attempt))
        last = (F.when if last is None else last.when)(script == s, _family(s, seed, attempt))
    # from the third attempt on, rows of digits get longer
    longer = F.concat(form, F.repeat(F.lit("0"), F.greatest(attempt - 2, F.lit(0))))
    card = _filled(F.substring(longer, F.lit(1), F.length(longer) - 1), seed)
    coded = F.concat(F.substring(form, 1, 2), _filled(F.substring(longer, F.lit(3), F.length(longer)), seed))
    hosts = _hash_digit(seed, F.lit(70), F.when(attempt < 3, F.lit(10_000)).otherwise(F.lit(1_000_000_000))).cast("string")
    return (
        F.when(kind == "email", F.concat(_filled(local, seed), F.lit("@mail"), hosts, F.lit(".example."), F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), _hash_digit(seed, F.lit(71), 3).cast("int") + 1)))
        .when(kind == "ip", _address(seed, attempt))
        .when(kind == "card", F.concat(card, _luhn(card)))
        .when(kind == "token", F.when(form.rlike("^[0-9a-f]+$"), _hexed(form, seed)).otherwise(_filled(form, seed)))
        .when(kind == "family", last)
        .when(kind == "name", F.when(family_of(form) == form, family).otherwise(F.concat_ws(" ", given, family)))
        .when(kind == "iban", coded)
        # numbers of 11 digits and more begin with a country code, which stays
        .otherwise(F.when((kind == "phone") & (F.length(form) > 10), coded).otherwise(_filled(longer, seed)))
    )


def rendered(mention: Column, kind: Column, form: Column, found: Column) -> Column:
    """The canonical surrogate in the mention's own format; what it is longer than the form follows at the end."""
    chars = F.split(mention, "")
    solid = F.transform(chars, lambda c: c.rlike("[A-Za-z0-9]").cast("int"))
    place = lambda i: F.aggregate(F.slice(solid, 1, i + 1), F.lit(0), lambda a, x: a + x)
    before = F.aggregate(solid, F.lit(0), lambda a, x: a + x) - F.length(form)  # a country code that the canonical form leaves out
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[A-Za-z0-9]") & (place(i) > before), F.substring(found, place(i) - before, F.lit(1))).otherwise(c)), "")
    spaced = F.concat(spaced, F.substring(found, F.length(form) + 1, F.length(found)))
    title = F.regexp_extract(mention, rf"^(?:{_TITLES})\.? ", 0)
    loud = kind.isin("email", "token") & mention.rlike("[A-Z]") & (mention == F.upper(mention))
    return F.when(kind.isin("card", "phone", "iban", "ssn"), spaced).when(loud, F.upper(found)).when(kind == "name", F.concat(title, found)).otherwise(found)


def _distinct(real: DataFrame, key: str) -> DataFrame:
    """(kind, form, found) of (kind, form, gender, family): all distinct within a kind and none a real form."""
    todo = real.withColumn("attempt", F.lit(0))
    done = None
    while True:
        tried = saved(todo.withColumn("found", surrogate(F.col("kind"), F.col("form"), F.col("gender"), key, F.col("attempt"), F.col("family"))))
        taken = real.select("kind", F.col("form").alias("found"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "found"))
        # who comes first among those with one surrogate keeps it; a grouped minimum, so a crowded value stays light
        first = tried.groupBy("kind", "found").agg(F.min("form").alias("first"))
        good = tried.join(first, ["kind", "found"]).filter("form = first").drop("first").join(taken, ["kind", "found"], "left_anti")
        good = saved(good.select("kind", "form", "found"))
        done = good if done is None else done.unionByName(good)
        left = saved(tried.join(good.select("kind", "form"), ["kind", "form"], "left_anti").select("kind", "form", "gender", "family", (F.col("attempt") + 1).alias("attempt")))
        if not left.limit(1).count():
            return done
        todo = left


def entities(mentions: DataFrame, key: str) -> DataFrame:
    """(kind, form, found): all distinct within a kind and none a real form. Family names get theirs first, so all names with one of them share it."""
    real = saved(mentions.groupBy("kind", "form").agg(F.max("gender").alias("gender")).withColumn("last", F.when(F.col("kind") == "name", family_of(F.col("form")))))
    nothing = F.lit(None).cast("string")
    families = real.filter("last IS NOT NULL").select(F.lit("family").alias("kind"), F.col("last").alias("form")).distinct().withColumns({"gender": F.lit(""), "family": nothing})
    families = saved(_distinct(saved(families), key).select(F.col("form").alias("last"), F.col("found").alias("family")))
    # only names have a family name; the other kinds don't meet at its null
    names = real.filter("last IS NOT NULL").join(families, "last").select("kind", "form", "gender", "family")
    others = real.filter("last IS NULL").select("kind", "form", "gender", nothing.alias("family"))
    return _distinct(saved(names.unionByName(others)), key)


def mentions_of(text: Column) -> Column:
    """All mentions in order; the whole pattern is tried only where a sign of personal data stands."""
    return F.when(text.rlike(SIGN), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def replace(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in the text; other columns pass. ``count_col`` names a column for the number of mentions.

    The lists of surrogates grow with the input, so they are joined by a shuffle
    at every size. Texts with one list of mentions share one list of surrogates, so copies are
    looked up once; texts without mentions are spread by their id and meet no
    other row.
    """
    text = F.col(f"`{text_col}`")
    listed_col, hash_col, found_col = fresh(docs, "_mentions"), fresh(docs, "_list"), fresh(docs, "_found")
    listed = docs.withColumn(listed_col, mentions_of(text))
    list_key = F.md5(F.concat_ws("\x00", listed_col))
    lists = saved(listed.filter(F.size(listed_col) > 0).select(list_key.alias("list"), F.col(listed_col).alias("mentions")).groupBy("list").agg(F.first("mentions").alias("mentions")))
    placed = lists.select("list", F.posexplode("mentions").alias("pos", "mention"))
    distinct = placed.select("mention").distinct()
    kind = kind_of(F.col("mention"))
    distinct = saved(distinct.select("mention", kind.alias("kind"), canonical(F.col("mention"), kind).alias("form"), gender_of(F.col("mention")).alias("gender")))
    known = distinct.drop("gender").join(entities(distinct, key), ["kind", "form"])
    known = saved(known.select("mention", rendered(F.col("mention"), F.col("kind"), F.col("form"), F.col("found")).alias("found")))
    found = placed.join(known, "mention").groupBy("list").agg(F.array_sort(F.collect_list(F.struct("pos", "found"))).alias("f"))
    found = saved(found.select(F.col("list").alias(hash_col), F.transform("f", lambda x: x["found"]).alias(found_col)))
    spread = F.concat(F.lit("-"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.crc32(text.cast("binary")).cast("string"), F.lit("")))
    side = listed.withColumn("_key_" + hash_col, F.when(F.size(listed_col) > 0, list_key).otherwise(spread))
    joined = side.join(found.hint("merge"), F.col("_key_" + hash_col) == F.col(hash_col), "left")
    pieces = F.zip_with(F.split(text, ANY, -1), F.concat(F.col(found_col), F.array(F.lit(""))), lambda p, f: F.concat(p, f))
    new = F.when(F.col(found_col).isNull(), text).otherwise(F.array_join(pieces, ""))
    out = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if count_col:
        out.append(F.when(F.col(found_col).isNull(), F.lit(0)).otherwise(F.size(found_col)).alias(count_col))
    return joined.select(*out)


def op9(spark, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_mentions")
