"""Template residue, filler and notices in place of content (problem 9).

Numbers, addresses and dates of a text are masked, the text is cut into messages (lines, their
parts and sentences), and each message is hashed in a normal form. The hashes are counted over all
documents and sources. All of it runs in the JVM; nothing is parsed row by row.

What a message is follows from two things. *Placeholders*, and a few wordings that mean one thing
only (an HTTP status line, a demand for JavaScript, lorem ipsum), decide by themselves. Everything
else that phrase rules find, such as hints of a form, dummy copy or notices of a site, may as well
be somebody's own sentence, so it counts only if the same masked message recurs in at least
``MIN_DOCS`` documents and ``MIN_SOURCES`` sources. The rules are applied once per such message.

The rules look for a subject, a state and a demand anywhere in a message of at most ``LONGEST``
words, in English, German, French and Spanish with some Italian and Portuguese, rather than for
whole known sentences. Messages with signs of a report (quotation marks, identifiers, paths, words
such as *because*) are content. So is what no rule finds, however often it recurs: people repeat
sentences too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rankweave.session import Workspace, spread

# Classes of a message.
CONTENT, SLOT, HINT, FILLER, NOTICE, NEUTRAL = range(6)
CLASS_NAMES = ("content", "slot", "hint", "filler", "notice", "neutral")

#: A message recurs widely if it stands in so many documents and sources; neither grows with the table.
MIN_DOCS = 3
MIN_SOURCES = 2
#: Words of the longest message that a phrase rule is for, and of a title (a line without end mark).
LONGEST = 30
TITLE = 5
#: Least share of function words in running text, of the language that fits best.
RUNNING = 0.15

# ---- placeholders (Java patterns)

_NAME = r"[A-Za-z_][\w .|-]{0,60}"
_FIELD = "name|number|date|address|title|company|e-?mail|phone|role|id|version|amount|city|url|link|reason|product|department"
SLOTS = "|".join(
    (
        r"\{%[^%\r\n]{0,80}%\}",  # {% block x %}
        r"<%=?[^%\r\n]{0,80}%>",  # <%= x %>
        r"\{\{\s*" + _NAME + r"\s*\}\}",  # {{ x }}
        r"(?<![\w/\\])[$#]\{\s*" + _NAME + r"\}(?![\w/\\])",  # ${x} #{x}
        r"%\(\w{1,60}\)[sdr]",  # %(x)s
        r"(?<![\w%])%[A-Za-z_]{1,60}%(?![\w%])",  # %X%
        r"@@\w{1,60}@@",  # @@x@@
        r"\[\[\s*" + _NAME + r"\s*\]\]",  # [[x]]
        r"<<\s*" + _NAME + r"\s*>>",  # <<x>>
        r"\[(?i:insert|your|enter|add) [\w ]{1,60}\]",  # [insert x]
        r"(?<![\w\])])\[[A-Z][A-Z_ ]{2,60}\](?![(\[])",  # [FIRST NAME]
        r"(?<![\w\])])\[(?:[A-Za-z]{2,20} ){0,2}(?i:" + _FIELD + r")\](?![(\[])",  # [Customer Name]
        r"<(?:insert |your )?[a-z_ ]{1,60} here>",  # <x here>
        r"<insert [a-z_ ]{1,60}>",
        r"(?<!\w)__[A-Z][A-Z_]{0,60}__(?!\w)",  # __X__
        r"(?<!\w)_{4,80}(?!\w)",  # _____
        r"(?<!\w)X{4,80}(?!\w)",  # XXXX
        # $x, but no currency and no shell variable in a path
        r"(?<![\w$/\\])\$(?!(?:usd|eur|gbp|chf|jpy|cad|aud)\b)[a-z][a-z_]{0,60}\b(?![/\\(])",
        r"(?<![\w$#%{'\"^/\\])\{[A-Za-z][A-Za-z_]{0,60}\}(?![}/\\])",  # {x}
    )
)
# What makes a placeholder the subject of a report: a word about templates, or a verb of showing
# or keeping right before it, or quotation marks around it.
_ABOUT = (
    r"(?iU)\b(?:placeholders?|templates?|literal(?:ly)?|verbatim|escap(?:e|es|ed|ing)|interpolat\w+|render(?:s|ed|ing)?|substitut\w+"
    r"|Vorlagen?|Platzhalter\w*|Schablonen?|gabarits?|mod[eè]le|substitu\w+|plantillas?|marcador(?:es)?|sustitu\w+)\b"
)
_QUOTES = "\"'`“”„«»‘’"
_MENTIONED = (
    r"(?U)\b(?i:leaves?|left|shows?|shown|prints?|printed|keep|kept|expands?|replaces?|uses?|use|reads?|sends?|emits?|outputs?|literal"
    r"|string|empty|text|zeigt|ersetzt|behält|affiche|remplace|laisse|muestra|sustituye|reemplaza|deja)\s{1,9}(?:an?\s|the\s)?(?:"
    + SLOTS + ")|[" + _QUOTES + "](?:" + SLOTS + ")[" + _QUOTES + "]"
)

# ---- words of the rules, all lower case


def _any(*lists: str) -> str:
    """A pattern for any of the words or phrases; a blank stands for itself, ``*`` for more letters."""
    words = [w.strip() for part in lists for w in part.split("|")]
    return r"(?U)(?<!\w)(?:" + "|".join(w.replace("*", r"\w*").replace(" ", r"\s") for w in words if w) + r")(?!\w)"


_SITE = (
    "page|pages|site|website|resource|requested|web page|webpage|link|url|address|access|session|account|ip|browser|login|captcha|gateway|hostname|host"
    "|connection|cookies|seite|webseite|sitzung|zugriff|verbindung|adresse|konto|accès|lien|connexion|navigateur|compte|página"
    "|pagina|sesión|acceso|enlace|sitio|dirección|conexión|navegador|cuenta|accesso|sessione|sito|acesso|sessão"
)
_PROJECT = (
    "repository|branch|thread|file|document|content|discussion|issue|diff|view|server|service|system|request|forum|wiki"
    "|tracker|archive|comments?|upstream|proxy|app|application|datei|thema|dienst|anfrage|projekt|fichier|serveur|dépôt|archivo"
    "|servicio|servidor|repositorio|sistema"
)
_GONE = (
    "not found|n.t found|could not be found|cannot be found|can.t be found|couldn.t be found|no longer available|no longer exists?"
    "|does not exist|doesn.t exist|not available|unavailable|denied|forbidden|expired|suspended|banned|not private|invalid|bad request"
    "|having trouble finding|trouble connecting|under maintenance|for maintenance|nicht gefunden|existiert nicht|nicht mehr verfügbar"
    "|nicht verfügbar|nicht erreichbar|verweigert|gesperrt|abgelaufen|introuvable|n.existe plus|n.existe pas|non trouvée?|refusé"
    "|interdite?|expirée?|indisponible|no existe|no encontrad[ao]|no disponible|no se encontró|denegad[ao]|prohibid[ao]|expirad[ao]"
    "|caducad[ao]|non trovata|non esiste|não encontrada|não existe|negato|scaduta"
)
_TROUBLE = (
    "broken|blocked|timed out|time-?out|maintenance|offline|down|unreachable|went wrong|cannot be shown|can.t be shown"
    "|cannot be displayed|can.t be displayed|cannot be loaded|could not be loaded|could not load|moved|errors?|closed|unexpected"
    "|temporarily|too many|wartung*|beendet|geschlossen|fehler|maintenance|fermée?|erreur|mantenimiento|cerrad[ao]|error|fuera de servicio"
    "|manutenzione|manutenção"
)
_SCRIPT_SURE = "javascript|java script|noscript"
_SCRIPT = "javascript|java script|noscript|js|scripts?|scripting|cookies|skripte"
_DEMAND = (
    "enabled?|enabling|activated?|allow|allowed|turn on|turned on|switch on|switched on|switched off|turned off|needs?|requires?|required|must"
    "|have to|works? only|only works?|not work|n.t work|work properly|blocks?|blocked|disabled|without|off|aktivieren|aktiviert|erlauben|einschalten"
    "|benötigt|erfordert|braucht|ohne|activer|activez|autorise[rz]|nécessite|requiert|désactivé|sans|active|activar|habilite|permita"
    "|necesita|requiere|desactivado|sin|abilita|ative"
)
_HUMAN = "human|robot|captcha|security check|your browser|sicherheitsprüfung|mensch|humain|humano"
_VERIFY = "verify|verifying|confirm|prove|check|checking|complete|bestätigen|vérifi*|confirme[rz]?|verifi*"
_LOGIN = (
    "logged in|signed in|sign in to|sign in again|sign in first|log in to|log in again|log in first|please log in|please sign in|permission to"
    "|melden sie sich|loggen sie sich|connecte[rz]|reconnecte[rz]|inicie sesión|iniciar sesión"
)
#: Notices that consist of little else.
_ALONE = (
    r"(?U)^(?:forbidden|unauthorized|bad gateway|bad request|internal server error|too many requests|not found"
    r"|service (?:temporarily )?unavailable|gateway time-?out|something went wrong\b.*|an? (?:unexpected |internal )?error (?:has )?occurred\b.*"
    r"|we(?:'ll| will) be back\b.*|interner serverfehler\b.*|etwas ist schiefgelaufen\b.*|zu viele anfragen\b.*|wartungsarbeiten\b.*"
    r"|une erreur est survenue\b.*|erreur (?:interne|serveur)\b.*|trop de requêtes\b.*|se ha producido un error\b.*|error interno\b.*"
    r"|demasiadas (?:solicitudes|peticiones)\b.*)$"
)
_SORRY = r"^(?:whoops|oops|sorry|uh-? ?oh)$"
_STATUS = (
    r"(?U)^(?:https? )?(?:status |error |fehler |erreur )?(?:code )?[45]\d\d(?: -)?(?:[.:,]? (?:error|not found|bad gateway|bad request|forbidden"
    r"|unauthorized|internal server error|service (?:temporarily )?unavailable|gateway time-?out|gone|page not found|too many requests"
    r"|method not allowed|request timeout|the \w+ .*|access denied|nicht gefunden|introuvable|no encontrad[ao]))?$"
)

_ASK = (
    r"(?U)^(?:please |bitte |veuillez |por favor,? )?(?:tell us|describe|paste|fill|insert|enter|attach|provide|explain|add|type|write|put|delete"
    r"|remove|leave|replace|list|include|beschreib\w*|erklär\w*|trag\w*|füg\w*|ersetz\w*|lösch\w*|nenn\w*|décri\w+|indique[rz]?|coll(?:er|ez)"
    r"|rempli\w+|supprim\w+|remplac\w+|ajoute[rz]|describ\w+|pegue|rellene|complete|borre|sustituya|escriba|añada)(?!\w)"
)
_HERE = _any(
    "here|below|this (line|hint|template|paragraph|section|field|text)|this hint|these hints|if applicable|hier|diesen abschnitt|diesen hinweis"
    "|ici|cette section|ce texte|aquí|esta sección|este texto"
)
_FIELDS = _any(
    "it|colon|sections?|applicable|fields?|template|steps?|logs?|release|version|module|problem|answer|instead|sentences?|empty|blank"
    "|screenshots?|name|example|environment|ausgabe|abschnitt*|text|texte|champs?|campos?|secci*|texto"
)
_HINT_SURE = (
    r"(?U)^(?:a clear and concise description\b.*|(?:your )?(?:text|answer|description|name|title) (?:goes )?here|if applicable, add\b.*"
    r"|steps to reproduce the behaviou?r)$"
)
_HINT = r"(?U)^(?:what|where|when|how|which) (?:did|do|are|have|were) you\b.{0,60}|.{0,40} goes here|go to '.{0,40}"

# Words that stand for nothing.
DUMMIES = tuple(
    """abc def ghi jkl asdf qwer qwerty foo bar baz xyz bla blah tbd todo tba test text xxx lorem ipsum dolor sit amet n/a 0""".split()
)
_DUMMY = _any(
    "dummy|filler text|filler copy|placeholder text|sample text|sample content|example text|sample paragraph|layout purposes|coming soon"
    "|real (description|text|content)|some more text|here be|to be (written|done|added|announced|determined|filled in)|lorem ipsum"
    "|blindtext|platzhaltertext|faux texte|texte factice|texto de relleno|texto de ejemplo"
)
#: Parts of a page around a notice: they are neither content nor a case by themselves.
_AROUND = (
    r"(?U)^(?:skip to (?:the )?(?:main )?content|(?:sign|log) (?:in|up|out)|register|help|(?:return|go|back) to\b.*|.*\btry (?:again|later|reloading)\b.*"
    r"|(?:please )?(?:slow down|wait|reload|refresh)\b.*|the address may be\b.*|.*\bmay have (?:been )?(?:moved|removed|deleted)\b.*"
    r"|if (?:this|the) (?:keeps?|problem|error|issue)\b.*|.*\bcontact (?:the|your|our)\b.*\b(?:administrator|support|webmaster|owner|team)\b.*"
    r"|(?:the )?redirect\w*\b.*|you (?:are|will) be(?:ing)? redirected\b.*"
    r"|(?:bitte )?versuchen sie es\b.*|zur startseite|(?:zurück|weiter) zu[rm]?\b.*|(?:veuillez )?réessaye[rz]\b.*|retour à\b.*|inténtelo\b.*|vuelva\b.*"
    r"|volver a\b.*|(?:request|error|ray|incident|reference|trace|correlation|vorgang|fehlercode|référence|referencia|código|code)"
    r"(?: id| code| number)?:? ?[\w-]*|[\W\d_]*)$"
)
_SERVER = r"^(?:powered by )?(?:apache )?(?:nginx|apache|openresty|cloudflare|tomcat)(?:/[\d.]+)?(?: server\b.*| \(\w+\))?$"
#: A message of these holds somebody's own thought or speaks about a message.
_REPORT_MARKS = r"[\"`“”„«»_/\\{}=\[\]]|\w\(|(?<!\bJava)(?<=\p{Ll})\p{Lu}|(?<!\p{L})'|'(?!\p{L})"
_REPORT_WORDS = _any(
    "when|whenever|because|although|should|raises?|returns?|renders?|bug|regression|handler|i|my|fails|since|weil|obwohl|parce|car"
    "|aunque|porque|cuando|lorsque"
)

# Frequent function words of four languages.
FUNCTION_WORDS = tuple(
    tuple(sorted(set(w.split())))
    for w in (
        """the a an and or of to in on at by for from with without is are was were be been it its this that these those as but not
        no so if when while than then into out up only still same all each every which who what where how there here we i you he
        she they our their his her your can could should would may will has have had do does did never always about after before
        because first two nothing both one any more most""",
        """der die das den dem des ein eine einen einem eines einer und oder aber nicht nur mit von vom für auf im in ist sind wird
        werden wurde hat haben etwa als wenn ob bei nach vor über unter zu zum zur aus dass weil obwohl sie er es ich wir ihr am
        beim durch ohne um bis erst mehr sehr noch auch sich zwei bitte dasselbe kein keine was wie wo""",
        """le la les l un une des du de d et ou mais ne n pas que qu qui dans sur pour par avec sans est sont sera été au aux ce
        cette ces il elle nous vous ils elles même déjà deux plus se sa son ses leur à fois""",
        """el la los las de un una unos del y o pero no que en con sin por para es son está fue ha se su sus al lo como más desde
        cuando si este esta estos estas dos hay a mismo alguien veces""",
    )
)
_PLAIN = r"(?<![\p{L}\p{N}_.])\p{L}{2,}(?![\p{L}\p{N}_(])"
_PROGRAM = r"[_/\\\d]|\w\(|\p{Ll}\p{Lu}"

# ---- normal form

_CLEAN = (
    (r"(?i)</?(?:html|head|body|title|h[1-6]|p|div|span|center|hr|br|noscript)(?:\s[^<>=]*=[^<>]*)?\s*/?>", "\n"),
    (r"[ \t\x0B\f\x{A0}]{2,}|[\t\x0B\f\x{A0}]", " "),
    (r"(?m)^ ?(?:[-*+>#]+|\d+[.)]|\[\d\d:\d\d\] ?\w+:) ", ""),
    (r"(?i)https?://\S*[\w/]|(?<![\w.+-])(?:www\.\S*[\w/]|[\w.+-]{1,64}+@[\w-]{1,64}\.[\w.-]{0,190}\w)|\[/[^\]\s]{0,200}\]", "@"),
    (
        r"\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d)?[\w:.+-]*\w)?|\b\d\d?(?:[./]\d\d?[./]\d{2,4}|:\d\d(?::\d\d)?)\b"
        r"|\b(?=[a-fA-F]{0,40}+\d)[0-9a-fA-F]{6,}\b"
        # numbers, but not a status code that stands alone
        r"|(?!(?<![\w.])[45]\d\d(?!\w|\.\d))(?<!\d)\d(?:[\d.]*\d)?",
        "0",
    ),
)
_CUT = r"[\r\n\x{85}\x{2028}\x{2029}]+| (?:[-–—|] |(?<=[.!?] )(?:[-–—|] )?)"


def messages(text: Column) -> Column:
    """The different messages of a text, masked: an array of strings."""
    text = reduce(lambda t, p: F.regexp_replace(t, F.lit(p[0]), F.lit(p[1])), _CLEAN, text)
    return F.array_distinct(F.array_remove(F.transform(F.split(text, _CUT), lambda s: F.trim(s)), ""))


def normal(message: Column) -> Column:
    """What is hashed: lower case, without marks around."""
    return F.trim(F.lower(message), F.lit(" .!?:;-…"))


def has_open_slot(message: Column) -> Column:
    """Whether a placeholder stands where a name or value belongs, not as subject of a report."""
    bare = F.regexp_replace(message, F.lit(_MENTIONED), F.lit(" "))
    return message.rlike(r"[{}%@\[<$]|XXXX|__") & bare.rlike(SLOTS) & ~F.regexp_replace(message, F.lit(SLOTS), F.lit(" ")).rlike(_ABOUT)


def _words(low: Column) -> Column:
    return F.size(F.split(low, " "))


def may_be_message(message: Column) -> Column:
    """Whether phrase rules are for it: no mark of a report, not too long."""
    often = reduce(Column.__or__, (message.contains(c) for c in ("_", "/", '"', "`", "\\", "{", "=")))
    return ~often & (_words(message) <= LONGEST) & ~message.rlike(_REPORT_MARKS)


def by_itself(message: Column) -> Column:
    """Class of a message by what needs no recurrence; null where that must decide."""
    low = normal(message)
    # a line without end mark, or a single word
    title = ((~F.substring(message, -1, 1).isin(".", "!", "?", "…") & (_words(message) <= TITLE)) | (_words(message) == 1)) & ~message.contains("/")
    tokens = F.filter(F.split(low, r"[ ,.!…:]+"), lambda t: t != "")
    dummies = F.filter(tokens, lambda t: t.isin(*DUMMIES))
    first = F.filter(F.slice(tokens, 1, 3), lambda t: t.isin(*DUMMIES))
    run = (F.size(first) == 3) & ((F.size(dummies) * 2 >= F.size(tokens)) | low.rlike(_DUMMY))
    doubt = low.rlike(_any(_GONE, _TROUBLE, _SCRIPT, _LOGIN, _VERIFY)) | low.rlike(_SORRY) | low.rlike(_DUMMY)
    sure = (
        F.when(low.rlike(_AROUND), NEUTRAL)
        .when(low.rlike(r"^(?:lorem|ipsum)\b"), FILLER)
        .when(low.rlike(r"^(?:" + "|".join(DUMMIES) + r")\b") & run, FILLER)
        .when(low.rlike(_ALONE) | low.rlike(_STATUS), NOTICE)
        .when(low.rlike(_HINT_SURE), HINT)
        .when((title & ~doubt) | low.rlike(_SERVER), NEUTRAL)
        .when(low.rlike(_REPORT_WORDS), F.lit(None))
        .when(low.rlike(_any(_SCRIPT_SURE)) & low.rlike(_any(_DEMAND)), NOTICE)
        .when(low.rlike(_any(_SITE)) & low.rlike(_any(_GONE)), NOTICE)
        .when(low.rlike(_any(_HUMAN)) & low.rlike(_any(_VERIFY)), NOTICE)
        .when(low.rlike(_ASK) & low.rlike(_HERE), HINT)
    )
    return F.when(has_open_slot(message), SLOT).when(may_be_message(message), sure).when((title & ~doubt) | low.rlike(_SERVER), NEUTRAL)


def if_recurring(message: Column) -> Column:
    """Class of a message that ``by_itself`` left open, given that it recurs widely."""
    low = normal(message)
    about = low.rlike(_any(_SITE, _PROJECT))
    kind = (
        F.when(low.rlike(_REPORT_WORDS), CONTENT)
        .when(low.rlike(_SORRY) | low.rlike(_any(_GONE)) | (about & low.rlike(_any(_TROUBLE))), NOTICE)
        .when((low.rlike(_any(_SCRIPT)) & low.rlike(_any(_DEMAND))) | low.rlike(_any(_LOGIN)), NOTICE)
        .when(low.rlike(_DUMMY), FILLER)
        .when((low.rlike(_ASK) & low.rlike(_FIELDS)) | low.rlike(_HINT), HINT)
        .otherwise(CONTENT)
    )
    return F.when(may_be_message(message), kind).otherwise(CONTENT)


def _how_many(words: tuple[str, ...]) -> Column:
    return F.size(F.filter("_w", lambda w: w.isin(*words)))


def classified(docs: DataFrame, doc: str, text: str, source: str, recurrence: bool = True) -> DataFrame:
    """``doc, source, message, hash, class`` of every different message of every document.

    ``message`` is masked, and null where it can be content only. Null and empty texts and rows without a document id have none; rows with
    the same id count as one document. A null source is a source of its own. A text in which no
    function word stands among four words or more and nothing looks like a program is filler. With
    ``recurrence`` off, messages that need it are content.
    """
    ws = Workspace(docs.sparkSession, "residue")
    slim = docs.select(
        F.col(f"`{doc}`").alias("_d"), F.lower(F.trim(F.col(f"`{source}`").cast("string"))).alias("_s"), F.col(f"`{text}`").alias("_t")
    ).where("_t IS NOT NULL AND _d IS NOT NULL")
    cut = spread(slim, "_d").select("_d", "_s", F.explode(messages(F.col("_t"))).alias("_m"))
    found = cut.withColumn("_h", F.xxhash64(normal(F.col("_m")))).withColumn("_k", by_itself(F.col("_m")))
    open_ = F.col("_k").isNull()
    found = found.withColumn("_u", open_ & may_be_message(F.col("_m"))).withColumn("_p", open_ & F.col("_m").rlike(_PROGRAM))
    # messages that look like a program need no count of words
    plain = F.regexp_extract_all(F.lower("_m"), F.lit(_PLAIN), F.lit(0))
    found = found.withColumn("_w", F.when(open_ & ~F.col("_p"), plain))
    known = [_how_many(words) for words in FUNCTION_WORDS]
    # the text of content is not needed again
    found = found.select(
        "_d", "_s", F.when(~open_ | F.col("_u"), F.col("_m")).alias("_m"), "_h", "_k", "_u", "_p",
        F.size("_w").alias("_n"), *(k.alias(f"_n{i}") for i, k in enumerate(known)),
    )
    found = ws.keep(found, "messages")
    undecided = found.where("_u")
    # hashes of document and source: fixed width, so the counts are combined before the shuffle
    counts = undecided.groupBy("_h").agg(
        F.count(F.lit(1)).alias("_c"), *(f(F.xxhash64(c)).alias(f"{c}{f.__name__}") for c in ("_d", "_s") for f in (F.min, F.max))
    )
    wide = counts.where((F.col("_c") >= MIN_DOCS) & F.expr("_dmin <> _dmax AND _smin <> _smax")).select("_h")
    if not recurrence:
        wide = wide.limit(0)
    once = undecided.join(wide, "_h", "left_semi").groupBy("_h").agg(F.min("_m").alias("_m"))
    told = once.select("_h", if_recurring(F.col("_m")).alias("_r")).where(F.col("_r") != CONTENT)
    told = ws.keep(told, "told")
    # a text of made-up words, judged on what is left of it
    left = found.join(told, "_h", "left").withColumn("_k", F.coalesce("_k", "_r", F.lit(CONTENT)))
    of = left.where(F.col("_k") == CONTENT).groupBy("_d").agg(
        F.max("_p").alias("_p"), *(F.sum(F.greatest(F.col(c), F.lit(0))).alias(c) for c in ("_n", "_n0", "_n1", "_n2", "_n3"))
    )
    made_up = of.where(~F.col("_p") & (F.col("_n") >= 4) & (F.greatest("_n0", "_n1", "_n2", "_n3") < RUNNING * F.col("_n")))
    left = left.join(made_up.select("_d", F.lit(FILLER).alias("_g")), "_d", "left")
    final = F.when(F.col("_k") == CONTENT, F.coalesce("_g", "_k")).otherwise(F.col("_k"))
    return left.select(
        F.col("_d").alias(doc), F.col("_s").alias(source), F.col("_m").alias("message"), F.col("_h").alias("hash"), final.alias("class")
    )


def without_content(messages_: DataFrame, doc: str) -> DataFrame:
    """Documents without content of their own, from ``classified``: ``doc, class``.

    A document is a case if it has an open slot, or if it has a hint, filler or notice and no
    content. ``class`` is the least number among the classes that made it one.
    """
    per = messages_.groupBy(doc).agg(
        F.max((F.col("class") == SLOT).cast("int")).alias("_slot"),
        F.max((F.col("class") == CONTENT).cast("int")).alias("_content"),
        F.min(F.when(F.col("class").isin(HINT, FILLER, NOTICE), F.col("class"))).alias("_bad"),
    )
    return per.where("_slot = 1 OR (_content = 0 AND _bad IS NOT NULL)").select(
        doc, F.when(F.col("_slot") == 1, F.lit(SLOT)).otherwise(F.col("_bad")).alias("class")
    )
