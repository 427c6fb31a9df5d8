"""Template residue, filler text and messages of failing sites in place of content.

Lines are masked, hashed and counted over all documents; the recurring messages are classified by phrases and slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import skew_join, spelled, written

#: Names of fields that templates fill in. Fixed values, like all patterns below; they are matched in lower case.
FIELDS = r"author|authors|title|page[_ ]title|name|first[_ ]name|last[_ ]name|date|year|entity|evidence|verdict|label|reference|references|claim|claim[_ ]text|claim[_ ]id|fever[_ ]id|judge[_ ]name|judge|item[_ ]id|statement|source|source[_ ]name|abstract|summary|text|url|email|company|city|user(name)?|content|body|description|placeholder|variable|value|insert[_ ][a-z_ ]+|your[_ ][a-z_ ]+"
_NAME = r"\s*[a-z][a-z0-9_.]*( [a-z0-9_]+){0,3}\s*"
#: A slot that nothing but a template writes.
SLOT = rf"\{{\{{\{{?{_NAME}\}}?\}}\}}|[$#]\{{{_NAME}\}}|<%=?{_NAME}%>|\{{%{_NAME}%\}}|@@{_NAME}@@|%\({_NAME}\)[sd]|<!--\s*template:[^>]*-->"
#: A slot whose marks have other uses too, so its name must be a field's or joined by underscores.
FIELD_SLOT = rf"(\[\[|\[|<|\{{|«|\$|%|__)\s*({FIELDS}|[a-z]+(_[a-z]+)+)\s*(\]\]|\]|>|\}}|»|\$|%|__)"
#: What fills a slot by hand.
PENDING = r"[\[(<{][^\])>}]{0,40}\b(to come|to be (confirmed|added|completed|supplied|determined|written|filled in|announced)|pending|goes here|text here|claim here|name here|title here|here)\s*[\])>}]|\bxxxx+\b|%s\b.*%[sd]\b|%d\b.*%s\b"
#: A sentence about slots.
ABOUT = r"\b(the signs?|serves? as|printed example|notation|syntax|braces|is written|are written|stands? for|a mark that|teaches|in the proof|the set|the matrix|the string|escaped)\b"
STUB = (
    r"^\W*(?:(todo|fixme|tbd|tba|tk)\b\W*.*|(insert|enter|add|put|type|paste|write)\b[\w ]{0,30}\bhere\W*$|(your|some|sample|dummy|placeholder|body|title|caption|abstract|summary|author|name|text|content|heading|image)( \w+){0,3} (goes|go|comes|belongs) here\b.*|(your|my) \w+( \w+)? here\W*$"
    r"|replace (this|the) \w+( \w+)? with\b.*|(author name|name surname|first name)\b[\w ,]{0,40}\W*$|(sample|example|dummy) (paragraph|text|heading|sentence|title)( (one|two|three|four|five|\d+))?\W*$|click (here )?to (edit|add|change)\b.*|heading \d+\W*$|(blah\W*){2,}$|(foo|bar|baz)( (foo|bar|baz))+\W*$|(caption|image|figure|text|title) (pending|missing|to follow)\W*$|this is (a |an )?(sample|placeholder|dummy|example) (text|page|paragraph|abstract)\b.*|(page|content|text|section) (coming soon|to follow|under construction)\W*$|coming soon\W*$|under construction\W*$|hello world\W*$|(?<again>\p{L}{2,6})( \k<again>){2,}\b.*|the quick brown fox\b.*)"
)
#: Words that the usual filler text is made of.
LOREM = r"\b(lorem|ipsum|dolor|dolore|amet|consectetur|adipiscing|elit|eiusmod|tempor|incididunt|labore|magna|aliqua|veniam|nostrud|exercitation|ullamco|laboris|aliquip|consequat|aute|irure|reprehenderit|voluptate|velit|cillum|fugiat|pariatur|excepteur|occaecat|cupidatat|proident|deserunt|mollit|laborum|sed|sit|ut|et|do)\b"
LOREM_OWN = r"\b(lorem|ipsum|dolor|amet|consectetur|adipiscing|eiusmod|incididunt|labore|aliqua|tempor|elit|nostrud|ullamco|excepteur)\b"
UNSET = r"\b(undefined|null|nan|none|\[object object\])(?!\w)"
ERROR = (
    r"^\W*(?:(error|fehler|erreur|errore|http|http error|status|error code|server error)( code| status)?[ :#–-]*[45]\d\d\b.{0,80}$|[45]\d\d\W+(\w+ ){0,2}(not found|forbidden|bad gateway|internal server error|service unavailable|too many requests|gateway time-?out|unauthori[sz]ed|gone|bad request|error|unavailable)\b.{0,60}$"
    r"|((page|file|document|resource|record|seite|article) )?(not found|nicht gefunden)\W*$|page introuvable\W*.*|p[aá]gina no encontrada\W*.*|(access|permission) (denied|forbidden)\W*$|forbidden\W*$|bad gateway\W*$|internal server error\W*$|service (is )?(temporarily |currently )?unavailable\W*$|too many requests\W*$|gateway tim(e-?|ed )out\b.*|zugriff verweigert\W*$|acc[eè]s (refus[eé]|interdit)\W*.*|acceso denegado\W*$"
    r"|(sorry, |oops[,!]? )?(the|this|that|la|die|cette) (requested |gew[uü]nschte |angeforderte )?(page|url|address|adresse|seite|resource|document|content|file|record|p[aá]gina)( you (are|were) (looking for|requested|trying to reach))? (could not|cannot|can't|was not|has been|does not|doesn't|is not|is no longer|is temporarily|gibt es|wurde|existiert|n'existe|demand[eé]e|no existe|ya no|solicitada)\b.{0,90}$"
    r"|an? (unexpected |internal |unknown |server )?error (has )?occurred\b.{0,80}$|something went wrong\b.{0,80}$|(unable|failed|could not|cannot|can't) (to )?connect to (the )?(database|server|host|service|backend)\b.{0,60}$|(database|connection) (error|refused|reset|timed out)\b.{0,60}$|traceback \(most recent call last\)\W*$|file \"[^\"]+\", line \d+.*|[a-z.]*(error|exception)\b: .{0,120}$|request id [0-9a-f-]{4,}\W*$|the (archive|site|server|service|page|database|system) is (currently |temporarily )?(down|offline|unavailable|under maintenance)\b.{0,80}$|(please )?try again (later|in a few minutes)\b.{0,80}$|please (try again|return|contact the administrator)\b.{0,80}$|you (do not|don't) have (the )?(permission|access|rights)\b.{0,80}$|(die|l[ea']) ?\w+ .{0,30}(nicht erreichbar|indisponible)\W*$)"
)
_SCRIPTS = r"(java ?script|scripts|cookies|scripting)"
WALL = (
    rf"^\W*(?:(please |bitte |veuillez |por favor,? )?(enable|activate|allow|accept|turn on|switch on|aktivieren sie|activez|activer|active|activa|habilite|permita|autorisez|abilita)( \w+)? {_SCRIPTS}\b.*|{_SCRIPTS} (is|are|ist|sind|est|sont|must be|needs? to be|has to be|est[aá]n?)( \w+)? ?(disabled|required|turned off|switched off|needed|off|blocked|enabled|on|deaktiviert|erforderlich|d[eé]sactiv[eé]s?|requis|n[eé]cessaires?|desactivados?)\b.*|(this (site|page|app|application|content|article|viewer)|you need to|you must|we need you to|your browser|ihr browser|votre navigateur|su navegador|to (view|read|see|use|continue)|um|pour|para)\b.{{0,60}}\b{_SCRIPTS}\b.*|(the|this) (widget|page|content|viewer|section|app|map|table) (failed to|could not|cannot|did not|won't) (load|be loaded|be shown|be displayed|render)\b.*|if (nothing|the page|this page|the content)\b.{{0,30}}\b{_SCRIPTS}\b.*|turn it on and reload\b.*"
    r"|(please )?(log|sign) ?in( again)?( first| here)? (to|or|for|with)\b.{0,60}$|you (must|need to|have to) (be logged in|log in|sign in|register)\b.*|your session (has )?(expired|timed out)\W*.*|(please )?(register|subscribe|create an account) to (continue|read|view)\b.*|(are you|you are not|confirm (that )?you are not|i'm not|i am not) a robot\b.*|(please )?(complete|solve|pass) the (check|captcha|challenge|test)\b.*|checking (your browser|if the site connection)\b.*|(please )?(verify|confirm|prove) (that )?you are (a )?human\b.*|this may take a few seconds\W*$|(please )?wait while (we|your)\b.*|we use cookies\b.*|enable\b.{0,20}\bcookies\b.*|(bitte )?(melden|loggen) sie sich\b.{0,60}$|veuillez vous (connecter|identifier)\b.*|(inicie|inicia) sesi[oó]n\b.*)"
)


#: Notices that content may hold as well, and words of such: they are residue only where they recur across sources.
AMBIGUOUS = r"^\W*(?:loading\W*$|(please )?wait\b.*|this may take (a few|some) (seconds|moments?|minutes)\W*$|we use cookies\b.*|(please )?try again (later|in a few minutes)\b.*|coming soon\W*$|under construction\W*$|hello world\W*$|heading \d+\W*$|the quick brown fox\b.*)"
CUE = r"\b(java ?script|captcha|reload|refresh|cookies|log ?in|sign ?in|web ?browser|ad ?block(er)?)\b"
_MONTH_DATE = r"\b(?=[adfjmnos])(january|february|march|april|may|june|july|august|september|october|november|december) \d+"
_ADDRESS = r"https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.]+"
_KEY = r"(?<!\p{L})'[a-z_ ]+'(?!\p{L})"
_NAMES = r"\b\p{Lu}\p{Ll}+( \p{Lu}\p{Ll}+)+\b"

#: What a line is by itself: nothing, an ambiguous cue, a phrase of residue, a mark that only templates write.
CUES, PHRASE, MARK = 1, 2, 3


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def _parts(segment: Column) -> dict[str, Column]:
    """What masking and classifying share: the line in lower case, its words, and whether it has marks, unset values or filler words at all."""
    low = F.lower(F.trim(segment))
    return {
        "low": low, "words": F.length(low) - F.length(F.replace(low, F.lit(" "))) + 1, "marked": low.rlike(r"[{}\[\]<>$%«@#(]") | low.contains("__") | low.contains("xxxx"),
        "unset": _holds(low, ("undefined", "null", "nan", "none", "[object")), "latin": _holds(low, ("lorem", "ipsum", "dolor", "amet", "consectetur", "adipiscing", "eiusmod", "incididunt", "labore", "aliqua", "tempor", "elit", "nostrud", "ullamco", "excepteur")),
    }


def _masked(segment: Column, low: Column, marked: Column, unset: Column, latin: Column) -> Column:
    """The words of a line in lower case, without numbers, dates and addresses; slots, quoted keys and runs of filler are one mark each.

    On lines that a template has filled in (slots or unset values) names are left out too, so that fillings of one
    template are one message.
    """
    x = F.when(marked | unset, F.lower(F.regexp_replace(segment, _NAMES, " "))).otherwise(low)
    x = F.when(marked, F.regexp_replace(F.regexp_replace(x, SLOT, " ⟨slot⟩ "), FIELD_SLOT, " ⟨slot⟩ ")).otherwise(x)
    # The lambda also keeps these many expressions out of one huge generated method, which no JIT compiles.
    addressed = F.exists(F.array(*map(F.lit, ("@", "http", "www."))), lambda w: F.contains(low, w))
    x = F.when(addressed, F.regexp_replace(x, _ADDRESS, " ")).otherwise(x)
    x = F.when(low.contains("'"), F.regexp_replace(x, _KEY, " ⟨slot⟩ ")).otherwise(x)
    x = F.when(latin, F.regexp_replace(x, rf"({LOREM}\W*)+", " ⟨filler⟩ ")).otherwise(x)
    return F.trim(F.regexp_replace(F.regexp_replace(x, _MONTH_DATE, " "), r"[^\p{L}⟨⟩]+", " "))


def _kind(low: Column, n: Column, marked: Column, unset: Column, latin: Column) -> Column:
    # Every slot has a mark; the phrases of stubs, errors and walls all begin the line.
    return (
        F.when(marked & (low.rlike(SLOT) | low.rlike(FIELD_SLOT) | low.rlike(PENDING)) & ~low.rlike(ABOUT), "placeholder")
        .when(latin & (F.regexp_count(low, F.lit(LOREM_OWN)) >= 2) & (F.regexp_count(low, F.lit(LOREM)) >= 0.7 * n), "filler")
        .when(unset & (n <= 16) & low.rlike(UNSET) & ((F.regexp_count(low, F.lit(UNSET)) >= 2) | low.rlike(rf"^\W*{UNSET}\W*$|:\s*{UNSET}\W*$")), "unset")
        .when((n <= 30) & low.rlike(STUB), "stub")
        .when((n <= 30) & low.rlike(ERROR), "error")
        .when((n <= 30) & low.rlike(WALL), "wall")
        .when((n <= 14) & (low.rlike(AMBIGUOUS) | low.rlike(CUE)), "cue")
    )


def _level(low: Column, kind: Column) -> Column:
    return F.when(kind.isin("placeholder", "filler"), MARK).when((kind == "cue") | (kind.isNotNull() & low.rlike(AMBIGUOUS)), CUES).when(kind.isNotNull(), PHRASE)


def masked(segment: Column) -> Column:
    """The normal form of a line: see :func:`_masked`."""
    p = _parts(segment)
    return _masked(segment, p["low"], p["marked"], p["unset"], p["latin"])


def rule(segment: Column) -> Column:
    """The kind of residue a line is by its phrases and slots: placeholder, filler, unset, stub, error, wall, an ambiguous cue, or null."""
    p = _parts(segment)
    return _kind(p["low"], p["words"], p["marked"], p["unset"], p["latin"])


def segments(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, segment): the distinct lines and sentences of every whole text, and how many it has; null and blank texts have none."""
    lines = F.filter(F.array_distinct(F.split("text", r"\s(?:(?<=\n)|(?<=[.!?]\s))\s*")), lambda x: F.trim(x) != "")
    split = documents.select("doc_id", spelled("source").alias("source"), lines.alias("lines"))
    return split.select("doc_id", "source", F.size("lines").alias("size"), F.explode("lines").alias("segment"))


def _lines(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash of the masked line in two halves, kind, level, example of a named line) of every line, written once."""
    prepared = segments(documents).withColumns({f"__{k}": c for k, c in _parts(F.col("segment")).items()})
    low, n, marked, unset, latin = (F.col(f"__{k}") for k in ("low", "words", "marked", "unset", "latin"))
    told = prepared.withColumns({"__message": _masked(F.col("segment"), low, marked, unset, latin), "kind": _kind(low, n, marked, unset, latin)})
    return written(
        told.select("doc_id", "source", "size", F.xxhash64("__message").alias("h1"), F.xxhash64(F.lit(1), "__message").alias("h2"), "kind", _level(low, F.col("kind")).alias("level"), F.when(F.col("kind").isNotNull(), F.substring("segment", 1, 200)).alias("example")), "lines"
    )


def _counted(lines: DataFrame) -> DataFrame:
    """Each message once: its kind and level, and whether it stands in several documents and sources.

    Smallest and largest document and source tell exactly whether there are two; they combine before the shuffle, so a
    message that stands in a third of all documents costs one row a task.
    """
    by = lines.groupBy("h1", "h2").agg(F.max(F.struct("level", "kind")).alias("x"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min("source").alias("s0"), F.max("source").alias("s1"))
    return by.select("h1", "h2", "x.kind", "x.level", (F.col("d0") < F.col("d1")).alias("recurs"), F.coalesce(F.col("s0") < F.col("s1"), F.lit(False)).alias("across"))


def messages(documents: DataFrame) -> DataFrame:
    """The recurring messages: hash, kind if a rule names one, documents, sources (of those known), and an example of a named one.

    Counts are exact and combine before the shuffle; a message recurs if two documents hold it. Repeated rows of a
    document count as often as they stand there.
    """
    lines = _lines(documents)
    by = lines.groupBy("h1", "h2", "source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.max("kind").alias("kind"), F.min("example").alias("example"))
    out = by.groupBy("h1", "h2").agg(F.max("kind").alias("kind"), F.sum("n").alias("n"), F.count("source").alias("n_sources"), F.min("example").alias("example"), F.min("d0").alias("d0"), F.max("d1").alias("d1"))
    return out.where("d0 < d1").select(F.format_string("%016x%016x", "h1", "h2").alias("hash"), "kind", "n", "n_sources", "example")


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kinds): documents with a line or sentence that is residue in place of content.

    ``documents`` has doc_id, text and source. Every line of every whole text is masked, hashed and counted over all
    documents, and messages are classified by rules: a phrase of a stub, an error, a wall or unset values is residue
    where the message recurs in two documents, an ambiguous cue (a cookie notice, "Loading...") where it recurs in two
    documents of two sources. Two things are residue even if they stand once: slots and filler, which nothing but a
    template writes, and phrases that make up half of their document's lines, as nothing stands beside them. Null and
    blank texts hold no residue, a repeated doc_id comes out once and doesn't make a message recur; a null source is
    no source of its own.
    """
    lines = _lines(documents)
    decided = _counted(lines).where("kind is not null").select(F.concat_ws("|", "h1", "h2").alias("h"), F.when(F.col("level") == CUES, F.col("recurs") & F.col("across")).otherwise(F.col("recurs")).alias("residue"))
    named = lines.where("kind is not null").select("doc_id", "size", "kind", "level", F.concat_ws("|", "h1", "h2").alias("h"))
    # A message that stands everywhere is a hot key of this join, hence the join that spreads it.
    told = skew_join(named, decided, "h")
    kinds = told.groupBy("doc_id").agg(
        F.collect_set(F.when((F.col("level") == MARK) | F.col("residue"), F.col("kind"))).alias("sure"), F.collect_set(F.when(F.col("level") >= PHRASE, F.col("kind"))).alias("all"),
        F.size(F.collect_set(F.when(F.col("level") >= PHRASE, F.col("h")))).alias("n"), F.max("size").alias("size"),
    )
    alone = F.col("n") * 2 >= F.col("size")
    return kinds.where((F.size("sure") > 0) | alone & (F.col("n") > 0)).select("doc_id", F.array_sort(F.when(alone, F.array_union("sure", "all")).otherwise(F.col("sure"))).alias("kinds"))
