"""Layer 2: names after roles, gazetteer finds, name spans and long-text windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluier.functions import spans as S

# Words of roles, relations, titles, particles and headings.
DOCTORS = "oncoloog cardioloog internist chirurg longarts nefroloog neuroloog pulmonoloog radiotherapeut patholoog radioloog".split()
RELATIVES = "partner dochter zoon schoonzoon echtgenoot echtgenote moeder vader broer zus contactpersoon mantelzorger".split()
LABELLED = [
    "verpleegkundig specialist", "physician assistant", "verwijzer huisarts", "verwijzend huisarts", "behandelend", "behandelend internist", "behandelend specialist", "hoofdbehandelaar", "verwijzer", "huisarts",
    "arts-assistent", "artsassistent", "co-assistent", "coassistent", "co-assistent aanwezig", "assisterend arts", "zaalarts", "supervisor", "dietist", "dietiste", "diëtist", "diëtiste", "patiëntnaam", "patientnaam",
]
BEFORE_NAMES = [
    "consulent", "apotheker", "triagist", "arts-assistent", "artsassistent", "co-assistent", "coassistent", "cardioloog", "verpleegkundig specialist", "verpleegkundige", "radioloog", "patholoog", "microbioloog", "oogarts",
    "zaalarts", "supervisor", "dietist", "dietiste", "diëtist", "diëtiste", "physician assistant", "i.o.m.",
]
BEFORE_SURNAMES = [
    "fysiotherapeut", "wijkverpleegkundige", "geboortenaam", "eerdergenoemde", "internist", "door collega", "via collega", "bij collega", "cc naar", "polikliniek bij", "fysiotherapie bij", "ingeschakeld via", "verstrekt door",
    "opgesteld door", "medeondertekend door", "ondertekend door", "fysiotherapie door", "fysiotherapie ingezet door", "physiotherapie door", "physiotherapie ingezet door", "ergotherapie door", "ergotherapie ingezet door",
    "logopedie door", "logopedie ingezet door",
]
TITLES = ["dr.", "drs.", "dhr.", "mevrouw", "mevr."]
PARTICLES = frozenset("de van der den ter el ibn 't".split())
HEADINGS = "Opgenomen Geboorte Geboortedatum Leeftijd Datum Reden Behandel Behandeling Opname Ontslag Conclusie Beloop Anamnese Medicatie Diagnose Werk Consult Gecontroleerd Opgesteld Verzonden Ingesteld Start Startte".split()


class Announcer(NamedTuple):
    """Words after which a name stands.

    link: what stands between (`:` a colon, perhaps in bold, `,` a comma, `(` a bracket, `door` up to 50 characters and that word,
    `word` one more word, else white space). most: words of the name at most. lead: words that must come next and belong to the find. titled: whether a
    title may or must (`needs`) stand before the name. behind: what must follow.
    """

    words: list[str]
    link: str = " "
    most: int = 3
    lead: tuple[str, ...] = ()
    titled: str = "may"
    behind: str = ""


_ROLE_BEHIND = rf"(?:{'|'.join(DOCTORS)}|oncolog\w+|verpleegkundig\s+specialist|medisch\s+oncoloog|huisarts)\b"
ANNOUNCERS = [
    Announcer(LABELLED, ":"),
    Announcer(["patiënt", "patient"], ":", 1, behind=r"\s*,\s*(?:voornaam|\d)"),
    Announcer(["voornaam"], " ", 3),
    Announcer(["notitie verpleegkundige"], " ", 1, behind=r"(?:\*{0,2}\s*)?:"),
    Announcer(BEFORE_NAMES),
    Announcer(["consulent"], "word"),
    Announcer(BEFORE_SURNAMES, most=1),
    Announcer(["huisarts"], titled="no"),
    Announcer(["consult"], "door", 1),
    Announcer([f"{before} {role}" for before in ("consult", "medeoverleg met") for role in [*DOCTORS, "geneeskundige", "specialist"]], most=1),
    Announcer(DOCTORS, most=1, titled="needs"),
    Announcer(DOCTORS, "(", 1, behind=r"\):"),
    Announcer(["verwijzer"], ":", lead=("huisarts",)),
    Announcer(["opgesteld door", "-"], lead=("verpleegkundig specialist",)),
    Announcer(["kopie aan", "kopie aan: huisarts"], ":", lead=("dr.", "drs.")),
    Announcer(["kopie aan: huisarts"], lead=("dr.", "drs.")),
    Announcer(["verstuurd aan huisarts"], ":", lead=("huisartsenpraktijk",)),
    Announcer(["dr.", "dr"], most=1, titled="no", behind=r"\s+(?:\([^)]{3,50}\)|(?:adviseert|besproken|rapporteert)\b)"),
    Announcer(["-"], behind=rf"\s*,\s*{_ROLE_BEHIND}"),
    Announcer(["behandeld door"], most=1, behind=rf",\s*{_ROLE_BEHIND}"),
    Announcer(RELATIVES),
    Announcer(RELATIVES, ","),
]
# A text without any of these words has no role name.
ROLE_GATE = r"(?iU)arts|assist|specialist|behandel|verwijz|supervisor|di[eë]tist|pati[eë]nt|voornaam|verpleeg|consul|apothek|triagist|loog|therap|geboortenaam|eerdergenoemd|mantelzorg|internist|collega|chirurg|\bdr\b|ondertekend|opgesteld|verstrekt|cc naar|polikliniek|ingeschakeld|kopie aan|contactpersoon|partner|dochter|zoon|echtgeno|moeder|vader|broer|\bzus\b|logopedie|i\.o\.m\."

_BOLD = r"\*{0,2}"
_LINKS = {":": rf"(?:\s+\([^)\n]+\))?{_BOLD}\s*:\s*{_BOLD}\s*", ",": r"\s*,\s*", "(": r"\s+\(", "door": r"\s[^.\n]{0,50}?\bdoor\s+", "word": r"\s+\w+\s+", " ": r"\s+"}
_TOKEN = re.compile(r"[^\W\d_][\w-]*|(?<![^\n])[ \t]*(-)(?=\s)")
_NAME_WORD = re.compile(r"[^\W\d_](?:\.(?=\s)|[\w'’-]*)")
_BLANKS = re.compile(r"[ \t]+")


def _any_of(words) -> str:
    return "(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") + ("" if w[-1] in ".-" else r"\b") for w in sorted(words, key=len, reverse=True)) + ")"


class NameScanner:
    """Reads names behind announcers: word by word through a text, with a look-up of the words that begin an announcer."""

    def __init__(self, announcers: list[Announcer] = ANNOUNCERS):
        self.starts: dict[str, list] = {}
        for row in announcers:
            by_first: dict[str, list[str]] = {}
            for words in row.words:
                by_first.setdefault(_TOKEN.match(words)[0] if words != "-" else "-", []).append(words)
            title = {"may": rf"(?:{_any_of(TITLES)}\s+)?", "needs": rf"{_any_of(['dr.', 'drs.'])}\s+", "no": rf"(?!{_any_of(TITLES)})"}[row.titled]
            lead = rf"(?={_any_of(row.lead)}\s)" if row.lead else title
            skip = re.compile(rf"(?i){_any_of(row.lead)}\s+") if row.lead else None
            behind = re.compile(rf"(?i){row.behind}") if row.behind else None
            for first, phrases in by_first.items():
                self.starts.setdefault(first, []).append((re.compile(rf"(?i){_any_of(phrases)}{_LINKS[row.link]}{lead}"), skip, row.most, behind))

    def names(self, text: str) -> list[tuple[int, int]]:
        found = set()
        for token in _TOKEN.finditer(text):
            at = token.start(1) if token[1] else token.start()
            for opening, skip, most, behind in self.starts.get(token[1] or token[0].lower(), ()):
                announced = opening.match(text, at)
                if not announced:
                    continue
                start = announced.end()
                end = self._name_end(text, skip.match(text, start).end() if skip else start, most)
                if end and not text[end : end + 1].isalnum() and not (start and text[start - 1].isalnum()) and (not behind or behind.match(text, end)):
                    found.add((start, end))
        return sorted(found)

    @staticmethod
    def _name_end(text: str, at: int, most: int) -> int | None:
        """Where a name that begins here ends: capitalised words and initials, particles between them; None if there is no name."""
        end, words = None, 0
        while words < most:
            if words:
                blanks = _BLANKS.match(text, at)
                if not blanks:
                    break
                at = blanks.end()
            word = _NAME_WORD.match(text, at)
            if word and words and word[0].islower() and word[0] in PARTICLES:
                blanks = _BLANKS.match(text, word.end())
                word = blanks and _NAME_WORD.match(text, blanks.end())
            if not word or not word[0][0].isupper() or (words and word[0] in HEADINGS):
                break
            end = at = word.end()
            words += 1
        return end


# Forms of address before a name, of one word or two; words that belong to a surname; role words that may lead a name.
ADDRESSES, ADDRESS_PAIR = ("mevrouw", "meneer", "mevr.", "dhr.", "mr.", "dr.", "drs."), ("de", "heer")
SURNAME_WORDS = ("van", "de", "den", "der", "te", "ten", "ter", "von", "'t")
LEADING, LEADING_PAIR = ("mevrouw", "dhr.", "dr.", "drs.", "mevr.", "huisarts", "huisartsenpraktijk"), ("verpleegkundig", "specialist")

# Model label -> type and confidence.
LABELS = {"PER": ("name", 0.90), "PERSON": ("name", 0.90), "ORG": ("org", 0.85), "LOC": ("location", 0.90), "GPE": ("location", 0.85), "FAC": ("location", 0.80)}
ROLE_CONFIDENCE, DICTIONARY_CONFIDENCE = 0.85, 1.0


def looks_like_name(value: Column) -> Column:
    """1 to 4 words behind titles and role words, each capitalised, an initial or a particle; headings are none. At least one word is judged."""

    def judged(words: Column) -> Column:
        leads = F.transform(words, lambda w, i: F.lower(w).isin(*LEADING) | ((F.lower(w) == LEADING_PAIR[0]) & (F.lower(F.get(words, i + 1)) == LEADING_PAIR[1])) | ((F.lower(w) == LEADING_PAIR[1]) & (i > 0) & (F.lower(F.get(words, F.greatest(i - 1, F.lit(0)))) == LEADING_PAIR[0])))
        first = F.array_position(F.transform(leads, lambda x: F.coalesce(x, F.lit(False))), False).cast("int")
        return F.slice(words, F.when(first > 0, first).otherwise(F.size(words)), F.size(words))

    good = lambda w: w.rlike(r"^[A-Z]\.$") | F.lower(w).isin(*PARTICLES) | w.rlike(r"^\p{Lu}")
    fits = lambda words: F.size(words).between(1, 4) & F.forall(words, good) & ~F.exists(words, lambda w: w.isin(HEADINGS))
    every = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    return F.coalesce(S.let(every, lambda words: F.when(F.size(words) > 0, S.let(judged(words), fits)).otherwise(False)), F.lit(False))


def role_name_spans(docs: DataFrame, text: str = "text", into: str = "names") -> DataFrame:
    """docs with an array (start, end, text) of names that a role, relation or label announces; texts without such a word skip the scan.

    Reading word by word with look-ups has no built-in function; one Arrow helper reads the texts of a batch.
    """

    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = NameScanner()
        for texts in batches:
            yield pd.Series([[{"start": a, "end": b, "text": t[a:b]} for a, b in scanner.names(t or "")] for t in texts], dtype=object)

    gated = F.when(F.col(text).rlike(ROLE_GATE), F.col(text))
    rows = docs.withColumn(into, scan(gated))
    return rows.withColumn(into, S.let(F.filter(into, lambda s: looks_like_name(s["text"])), drop_subsumed))


def drop_subsumed(spans: Column) -> Column:
    """Without spans that lie strictly inside another."""
    inside = lambda s, o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & ((o["end"] - o["start"]) > (s["end"] - s["start"]))
    return F.filter(spans, lambda s: ~F.exists(spans, lambda o: inside(s, o)))


#: Characters before a span that are read first.
NEAR = 48


def expand_name_span(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Left over a form of address or else a row of surname words, right over endings behind apostrophes. Words are read one by one outwards from the span."""

    def spoken(left: Column) -> Column:
        # A word with the blanks behind it, or another sign: together they are the whole left side, here from the last of them on.
        chunks = F.reverse(F.regexp_extract_all(left, F.lit(r"(?sU)['\w]+\.?\s*|."), F.lit(0)))
        return F.transform(chunks, lambda c: F.struct(F.length(c).alias("n"), F.when(c.rlike(r"(?U)\s$"), F.lower(F.regexp_replace(c, r"(?U)\s+$", ""))).alias("word")))

    known = lambda w: F.coalesce(w["word"].isin(*SURNAME_WORDS), F.lit(False))

    def taken(words: Column) -> Column:
        first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
        ends = lambda w: F.coalesce(reduce(or_, (w.endswith(x) for x in SURNAME_WORDS)), F.lit(False))

        def step(state: Column, w: Column) -> Column:
            taken = F.when(~state["on"], state["n"]).when(known(w), state["n"] + w["n"]).when(ends(w["word"]), 0).otherwise(state["n"])
            return F.struct(taken.alias("n"), (state["on"] & known(w)).alias("on"))

        # A word that only ends like a surname word spoils the row: the span would grow from inside it.
        row = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), step, lambda s: s["n"])
        return F.coalesce(F.when(first["word"].isin(*ADDRESSES), first["n"]).when((first["word"] == ADDRESS_PAIR[1]) & (second["word"] == ADDRESS_PAIR[0]), first["n"] + second["n"]).otherwise(row), F.lit(0))

    # Most often the last characters tell: two words, and one that ends the row. They are read from where a word or sign begins; else the whole left side is.
    cut = F.regexp_replace(F.substring(text, start - NEAR + 1, F.lit(NEAR)), r"(?U)^['\w]*\.?\s*", "")
    whole = lambda: S.let(spoken(F.substring(text, F.lit(1), start)), taken)
    near = S.let(spoken(cut), lambda words: F.when((F.size(words) >= 2) & F.exists(words, lambda w: ~known(w)), taken(words)).otherwise(whole()))
    before = F.when(start > NEAR, near).otherwise(whole())
    # What follows, cut before each apostrophe; endings go on as long as such a part is nothing but letters behind its apostrophe.
    parts = F.split(F.substring(text, end + 1, F.length(text)), "(?=['’])")
    length = lambda p: F.length(F.regexp_extract(p, r"(?U)^['’][\w-]+", 0))
    ending = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, p: F.struct(F.when(s["on"], s["n"] + length(p)).otherwise(s["n"]).alias("n"), (s["on"] & (length(p) == F.length(p))).alias("on")), lambda s: s["n"])
    return start - before, end + F.when(F.substring(text, end + 1, F.lit(1)).isin("'", "’"), ending).otherwise(0)


NAME = "array<struct<start:int,end:int,text:string,confidence:double>>"


def merge_name_spans(names: Column, additions: Column, text: Column) -> Column:
    """Additions against names found before (both: start, end, text, confidence), in order.

    Without overlap an addition joins; if it is longer than all it overlaps it replaces them; else it goes, but a role find
    inside a name that holds ` aan ` or ` bij ` with an article replaces that name.
    """

    def add(kept: Column, x: Column) -> Column:
        hit = F.filter(kept, lambda y: S.overlap(x, y))
        rest = F.filter(kept, lambda y: ~S.overlap(x, y))
        longer = F.forall(hit, lambda y: (x["end"] - x["start"]) > (y["end"] - y["start"]))
        role_inside = (x["confidence"] == ROLE_CONFIDENCE) & F.exists(hit, lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & y["text"].rlike(r"(?i) (aan|bij) (de|het)\b"))
        return F.when((F.size(hit) == 0) | longer | role_inside, F.concat(rest, F.array(x))).otherwise(kept)

    return F.array_sort(F.aggregate(additions, names.cast(NAME), add))


def coalesce_names(spans: Column) -> Column:
    """The longest spans that don't overlap, in the order of the text; of equal length the later end first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("by_length"), (-s["end"]).alias("by_end"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))))
    kept = S.resolve(ordered, "array<struct<by_length:int,by_end:int,start:int,end:int,text:string>>")
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["start"], s["end"], s["text"])))


def supplement_names(names: Column, additions: Column, text: Column) -> Column:
    """Names of a second finder where they help: merge, expand, keep the longest."""
    merged = merge_name_spans(names, additions, text)

    def grown(s: Column) -> Column:
        start, end = expand_name_span(text, s["start"], s["end"])
        return S.let(F.struct(start.alias("start"), end.alias("end")), lambda at: F.struct(at["start"], at["end"], F.substring(text, at["start"] + 1, at["end"] - at["start"]).alias("text")))

    return coalesce_names(F.transform(merged, grown))


#: Bits of a field for each entry, places that an entry sets, and blocks of bits at most (of 32768: 32 MB in all).
FIELD_BITS, FIELD_HASHES, FIELD_BLOCKS = 10, 2, 8192
_BLOCK = 32768


def _field_places(surface: Column, bits: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), surface), bits) for i in range(FIELD_HASHES)]


def listed_surfaces(gazetteer: DataFrame) -> Callable[[Column], Column]:
    """A test whether a surface may be in a gazetteer: never false for one that is, and rarely true for another while the field isn't at its greatest size.

    The field is an array of bit maps, made by an aggregate for each block of bits and read as a subquery of one row.
    """
    blocks = F.least(F.lit(FIELD_BLOCKS), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * FIELD_BITS / _BLOCK))).cast("long")
    size = gazetteer.agg((blocks * _BLOCK).alias("bits"))
    set_ = gazetteer.select("surface").crossJoin(F.broadcast(size)).select(F.explode(F.array(*_field_places(F.col("surface"), F.col("bits")))).alias("p"))  # size has one row
    maps = set_.groupBy(F.floor(F.col("p") / _BLOCK).alias("block")).agg(F.bitmap_construct_agg(F.col("p") % _BLOCK).alias("map"))
    every = size.select(F.explode(F.sequence(F.lit(0).cast("long"), (F.col("bits") / _BLOCK).cast("long") - 1)).alias("block")).join(maps, "block", "left")
    field = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "map"))), lambda x: x["map"]).alias("field")).scalar()

    def may(surface: Column) -> Column:
        bits = F.size(field).cast("long") * _BLOCK

        def is_set(p: Column) -> Column:
            byte = F.conv(F.hex(F.substring(F.get(field, F.floor(p / _BLOCK).cast("int")), (F.floor(p % _BLOCK / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.coalesce(F.getbit(byte, (p % 8).cast("int")) == 1, F.lit(False))

        tests = [is_set(p) for p in _field_places(surface, bits)]
        return reduce(and_, tests)

    return may


def gazetteer_grams(docs: DataFrame, grams: Column, may: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, start, end, surface) of the n-grams that may be listed. Texts and words stay behind, and the test comes in the same step, before any exchange."""
    rows = docs.select("doc_id", S.each(grams).alias("g")).filter("g is not null").select("doc_id", "g.start", "g.end", "g.surface")
    return rows.filter(may(F.col("surface")))


def dictionary_entities(docs: DataFrame, gazetteer: DataFrame, most_words: int = 4, max_rows: int = 1_000_000) -> DataFrame:
    """Rows of docs (doc_id, text) that hold entries of a gazetteer (surface, entity_type): doc_id, start, end, text, entity_type.

    Word n-grams meet the entries by equality; of overlapping finds the longest stays. Before they leave their row, n-grams are tested against a bit
    field of the entries, so what is joined follows the hits and not the words. A gazetteer below max_rows is broadcast, a larger one is joined by
    shuffle on the n-gram.
    """
    words = S.scan(F.col("text"), r"\w[\w'-]*")

    def grams_of(w: Column) -> Column:
        def gram(i: Column, n: Column) -> Column:
            surface = F.array_join(F.transform(F.slice(w, i + 1, n), lambda x: x["text"]), " ")
            return F.struct(F.get(w, i)["start"].alias("start"), F.get(w, i + n - 1)["end"].alias("end"), surface.alias("surface"))

        at = F.sequence(F.lit(0), F.size(w) - 1)
        every = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most_words), F.size(w) - i)), lambda n: gram(i, n))))
        # Words with more than a blank between them are no n-gram.
        return F.when(F.size(w) > 0, F.filter(every, lambda g: g["end"] - g["start"] == F.length(g["surface"])))

    grams = gazetteer_grams(docs, S.let(words, grams_of), listed_surfaces(gazetteer))
    small = gazetteer.limit(max_rows + 1).count() <= max_rows
    found = grams.join(F.broadcast(gazetteer) if small else gazetteer, "surface")
    row = F.struct((F.col("start") - F.col("end")).alias("by_length"), "start", "end", F.col("surface").alias("text"), "entity_type")
    kind = "array<struct<by_length:int,start:int,end:int,text:string,entity_type:string>>"
    kept = found.groupBy("doc_id").agg(S.resolve(F.array_sort(F.collect_list(row)), kind).alias("kept"))
    return kept.select("doc_id", F.explode("kept").alias("k")).select("doc_id", "k.start", "k.end", "k.text", "k.entity_type", F.lit(DICTIONARY_CONFIDENCE).alias("confidence"))


def map_labels(found: DataFrame) -> DataFrame:
    """Model finds (label, ...) with entity_type and confidence; unknown labels go."""
    known = found.sparkSession.createDataFrame([(k, t, c) for k, (t, c) in LABELS.items()], "label string, entity_type string, confidence double")
    return found.join(F.broadcast(known), "label")


def text_windows(docs: DataFrame, limit: int = 2000, overlap: int = 400) -> DataFrame:
    """(doc_id, window, offset, part): windows of at most limit characters; the last ends where the text ends."""
    n = F.length("text")
    starts = F.when(n <= limit, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - limit + (limit - overlap) - 1, F.lit(limit - overlap)))
    rows = docs.select("doc_id", "text", F.posexplode(F.transform(starts, lambda s: F.greatest(F.lit(0), F.least(s, n - limit)))).alias("window", "offset"))
    return rows.select("doc_id", "window", "offset", F.substring("text", F.col("offset") + 1, F.lit(limit)).alias("part"))


def merge_window_spans(found: DataFrame) -> DataFrame:
    """Finds of windows (doc_id, offset, start, end, entity_type, score) at their place in the text; of overlapping ones the higher score stays, the first on a tie."""
    placed = found.select("doc_id", F.struct((F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"), "entity_type", "score").alias("s")).distinct()
    kind = "array<struct<start:int,end:int,entity_type:string,score:double>>"

    def add(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        clash = last.isNotNull() & S.overlap(last, x)
        return F.when(~clash | last.isNull(), F.concat(kept, F.array(x))).when(x["score"] > last["score"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).otherwise(kept)

    merged = placed.groupBy("doc_id").agg(F.aggregate(F.array_sort(F.collect_list("s")).cast(kind), S.none(kind), add).alias("kept"))
    return merged.select("doc_id", F.explode("kept").alias("k")).select("doc_id", "k.*")


def model_spans(docs: DataFrame, detect: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Finds of a detector of the user's: detect(texts) gives a list of dicts (start, end, label) for each text. Loaded once a worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(i, s["start"], s["end"], s["label"]) for i, spans in zip(rows["doc_id"], detect(rows["text"]), strict=True) for s in spans]
            yield pd.DataFrame(found, columns=["doc_id", "start", "end", "label"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start int, end int, label string")
