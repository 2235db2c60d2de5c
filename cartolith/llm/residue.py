"""Template residue, filler, error pages and demands for scripts.

Each text is read once. The placeholder detector looks at every sentence for
fields and program values that no template filled in, and passes over those a
text only mentions. For the rest address slug, title and body are taken apart:
menu, notices, footer and title come off, and each sentence left is reduced to
a template (numbers masked). A body says nothing about its own page if all its
templates come back over the whole corpus, under addresses and titles that have
no word in common with them, on several hosts, and in nearly every document
that has them make up the whole body together. A vocabulary of errors, filler
and script notices serves as a weak prior for wordings too rare for that, and
is overruled where the corpus shows such a sentence beside real content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from http import HTTPStatus
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship

# ---------------------------------------------------------------- placeholders

_NAME = r"[A-Za-z][\w.]*"
_FIELD = rf"(?:{_NAME}|(?:Your|Ihre?|Votre|Su)\s{_NAME}|insert\s{_NAME}\shere|\d)"
#: Syntaxes of template fields.
FIELDS = re.compile(rf"""
    \{{\{{\{{?\s*{_FIELD}\s*\}}?\}}\}} | [$#]\{{\s*{_FIELD}\s*\}} | \{{%\s*(?:\w+\s+)?{_FIELD}\s*%\}} | (?<![\w#\d\s]\s)(?<![$#\w])\{{{_FIELD}\}} | (?<=\s)(?<!\#\d\s)\{{{_FIELD}\}}
  | (?:<|&lt;)[%?]=?\s*\$?{_FIELD}\s*[%?](?:>|&gt;) | &\#123;(?:&\#123;)?\s*{_FIELD}\s*&\#125;(?:&\#125;)?
  | \[\[\s*{_FIELD}\s*\]\] | (?<!\w)\[(?!\d)(?!(?:sic|at|dot|edit|note|ref|i|ii|iii|iv|v|x)\]){_FIELD}\] | \[object\ Object\]
  | <[A-Za-z]+_[A-Za-z_]+> | <[A-Z][A-Z_]{{2,}}>
  | @@{_NAME}@@ | (?<!\w)%\({_NAME}\)[sd] | (?<![\w%])%(?:\d\$)?[sd](?!\w) | (?<!\w)%{_NAME}%(?!\w) | (?<!\w)\${_NAME}\$(?!\w) | (?<!\w)\#{_NAME}\#(?!\w)
  | \*\|{_NAME}\|\* | «(?:[a-z][\w.]+|[A-Z][A-Z_.\d]+)(?:»|Â») | (?<![\w:]):{_NAME}:(?!\w) | (?<!\w)__{_NAME}?[A-Za-z.]__(?!\w)
  | (?<![\w?])\?\?\?(?![\w?]) | \bi18n:[\w.]+ | (?<![\w./@:])(?!www\.|m\.|maps\.)[a-z]\w*\.[A-Za-z]\w*\.(?:label|text|title|name|msg|message|key|value|caption|heading|hint)\b
""", re.X)
#: Brackets nothing but templates has: whatever stands between them on a line is a field.
_OPEN = re.compile(r"\{\{\{?|\{%|\$\{|(?:<|&lt;)(?:%|\?(?!xml\b))|&#123;&#123;")
_CLOSE = {"{": re.compile(r"\}\}\}?"), "{%": re.compile("%\\}"), "${": re.compile(r"\}"), "%": re.compile("%(?:>|&gt;)"), "?": re.compile(r"\?(?:>|&gt;)"), ";": re.compile("&#125;&#125;")}
_SETS = re.compile(r"\}\s*,\s*\{")
#: Program values that stand for a missing one.
VALUES = re.compile(r"(?<![\w.'\"-])(?:undefined|null|NaN|None)(?![\w'\"-])(?!\.\w)")
_MAYBE = re.compile(r"[{«@]|\[[A-Za-z\[]|<[%?A-Za-z]|&lt;[%?]|&#123|%[\w(%]|\$[{A-Za-z]|#[{A-Za-z]|\*\||:\w[\w.]*:|__|\?\?\?|undefined|null|NaN|None|i18n|[a-z]\.\w+\.[a-z]")
#: Words before undefined and null that make them words of the sentence if what they qualify follows, and those that do so without.
_PROSE = frozenset("and or the a an is are was were not no with und oder ein eine et ou un une y o el la".split())
_SAID = frozenset("is are was were not".split())
#: German number words: null before a unit.
_COUNTED = re.compile(r" (?:Grad|Uhr|Prozent|Euro|Komma)\b")
#: Terms of mathematics, law and programming that null and undefined belong to.
_TERM = re.compile(r"\s+(?:hypothes[ie]s|values?|pointers?|results?|behaviou?rs?|sets?|vectors?|spaces?|references?|terminators?|characters?|strings?|variables?|symbols?|borders?|islands?|terms?)\b")
#: Places of a name, where None is no pronoun or name of a place.
_NAMED = re.compile(r"(?:: |^\W*(?:hello|hi|hey|dear|welcome|hallo|liebe[rs]?|guten tag|bonjour|ch[eè]re?|hola|estimad[oa]|querid[oa]),? |\b(?:written by|posted by|escrito por|publicado por|geschrieben von|verfasst von|[ée]crit par|publi[ée] par) )$", re.I)
#: What stands right before or behind a field that is spoken about instead of shown.
_NOUN = (r"(?:examples?|exemple|ejemplo|beispiel|templates?|vorlage|gabarit|plantilla|variables?|variablen?|placeholders?|platzhalter|strings?|arguments?|"
         r"parameters?|merge fields?|methods?|methode|méthode|método|functions?|funktion|fonction|función)")
_BEFORE = re.compile(
    rf"(?:\b(?:such as|for example|e\.g\.|zum beispiel|z\. ?b\.|par exemple|por ejemplo|tels? que|tal como)|\b(?:the|a|an|der|die|das|eine?|la|le|une?|el)\s+{_NOUN}"
    r"|\b(?:example|exemple|ejemplo|beispiel|code sample)\s?:\s*[«\"“„‘`])\W*$", re.I)
_BEHIND = re.compile(rf"\W*(?:(?:for|as|als|comme|como|pour|para|für)\s+(?:\w+\s+){{0,2}}{_NOUN}\b|(?:turns? into|becomes|wird zu|pasa a ser|devient)\b)", re.I)
#: Joins a field to one before it that is spoken about.
_JOINS = re.compile(r"(?:\b(?:then|and|or|dann|und|oder|puis|et|ou|luego|y|o)|,)\s*$", re.I)
#: Lines of program logs: what they show belongs to the program, not to a page.
_LOG = re.compile(r"^\s*(?:warning: \w+\(|fatal: |notice: |#\d+ |at \w[\w.$]*\()", re.I)
_QUOTES = {'"': '"', "“": "”", "„": "“", "`": "`", "'": "'", "‘": "’", "«": "»", "?": "?", "\x93": "\x94", "\x84": "\x93", "\x91": "\x92", "\ufffd": "\ufffd"}
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def _quoted(s: str, a: int, b: int) -> bool:
    left, right = s[:a].rstrip("   Â"), s[b:].lstrip("   Â")
    # quotes of damaged encodings all begin alike
    return bool(left and right) and (_QUOTES.get(left[-1]) == right[0] or bool(right[0] == "â" and re.search(r"â\W{0,2}\w?$", left)))


def _mentioned(s: str, hits: list[tuple[int, int]]) -> list[bool]:
    """Whether each of the hits, in order, is quoted or spoken about; what stands inside other hits does not matter."""
    masked = list(s)
    for a, b in hits:
        masked[a:b] = "#" * (b - a)
    line, out, last = "".join(masked), [], None
    for a, b in hits:
        said = _quoted(s, a, b) or bool(_BEFORE.search(line[max(0, a - 60) : a]) or _BEHIND.match(line[b : b + 80]))
        said = said or bool(last is not None and a - last < 40 and _JOINS.search(line[last:a]))
        out.append(said)
        last = b if said else None
    return out


def _is_value(s: str, a: int, b: int) -> bool:
    """Whether undefined, null, NaN or None at s[a:b] is a program's, not a word of the sentence."""
    value, before = s[a:b], s[:a].split()
    if value == "NaN":
        return True
    if value == "None":
        return bool(_NAMED.search(s[:a]))
    if value == "null" and _COUNTED.match(s, b):
        return False
    if value in ("null", "undefined") and _TERM.match(s, b):
        return False
    last = before[-1].lower() if before else ""
    return not (last in _PROSE and re.match(r"\s+[^\W\d]", s[b:]) or last in _SAID and value == "undefined")


def _expressions(text: str) -> list[tuple[int, int]]:
    """Spans of non-empty expressions in brackets of templates."""
    out, pos, unclosed = [], 0, {}
    while m := _OPEN.search(text, pos):
        pos = m.end()
        kind = m.group() if m.group() in _CLOSE else m.group()[-1]
        if m.start() < unclosed.get(kind, 0):
            continue
        eol = text.find("\n", pos)
        eol = len(text) if eol < 0 else eol
        end = _CLOSE[kind].search(text, pos, eol)
        if not end:
            unclosed[kind] = eol
        elif re.search(r"\w", inner := text[pos : end.start()]) and not _SETS.search(inner):
            out.append((m.start(), end.end()))
            pos = end.end()
    return out


def _sentences(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Each sentence, and the spans of expressions in it; none is broken within one."""
    spans, at, k, done = _expressions(text), 0, 0, 0
    for m in [*_SENTENCE.finditer(text), None] if spans else ():
        cut = m.start() if m else len(text)
        while k < len(spans) and spans[k][1] <= cut:
            k += 1
        if not (k < len(spans) and spans[k][0] < cut):
            yield text[at:cut], [(a - at, b - at) for a, b in spans[done:k]]
            at, done = m.end() if m else cut, k
    if not spans:
        for s in _SENTENCE.split(text):
            yield s, []


def shows_field(text: str) -> bool:
    """Whether a field or program value stands where a value belongs, anywhere in text."""
    if not _MAYBE.search(text):
        return False
    for s, spans in _sentences(text):
        if not _MAYBE.search(s) or _LOG.match(s):
            continue
        hits = [(m.start(), m.end()) for m in FIELDS.finditer(s)]
        hits += [(m.start(), m.end()) for m in VALUES.finditer(s) if _is_value(s, m.start(), m.end())]
        if spans:
            hits = [h for h in hits if not any(a < h[1] and h[0] < b for a, b in spans)] + spans
        if hits and not all(_mentioned(s, sorted(hits))):
            return True
    return False


# ------------------------------------------------------------- low information

def skeleton(s: str) -> str:
    """Lower case without anything outside ASCII, so that damaged letters make no difference."""
    s = re.sub(r"[^\x00-\x7f]+", "", s.replace(" ", " ").replace("’", "").replace("‘", ""))
    s = re.sub(r"(?<=\w)[?'](?=\w)", "", s)
    return re.sub(r"\s+", " ", s).strip().lower()


def _words(s: str) -> frozenset:
    return frozenset(w for w in re.findall(r"[a-z]+", skeleton(s)))


#: Words of menus.
MENU = _words("""Home News Events Shop Archive About us Contact Search Login Help Maps Trails Startseite Aktuelles Termine Laden Archiv Über uns
Kontakt Suche Anmelden Hilfe Karten Wege Accueil Actualités Agenda Boutique Archives À propos Contact Recherche Connexion Aide Cartes Sentiers
Inicio Noticias Agenda Tienda Archivo Quiénes somos Contacto Buscar Entrar Ayuda Mapas Rutas""")
#: Notices and footers, on skeletons.
BOILERPLATE = re.compile("^(?:" + "|".join([
    r"(?:we use|this site stores|wir verwenden|diese seite speichert|nous utilisons|ce site d?pose|usamos|este sitio guarda) [^.]*\b(?:cookies?|files|dateien|fichiers|archivos)\b.*",
    r"cookie(?:s| preferences) ?:.*", r"(?:all rights reserved|alle rechte vorbehalten|tous droits r\w*s|todos los derechos reservados)\.?",
    r"imprint \| .*", r"impressum \| .*", r"mentions l\w* \| .*", r"aviso legal \| .*", r"back to top|nach oben|haut de page|volver arriba",
    r"(?:last changed|stand ?:|mis jour le|mis a jour le|actualizado el) ?[\d./-]+", r"(?:printed from|gedruckt von|imprim\w* depuis|impreso desde) \S+",
    r"(?:accept all|alle zulassen|tout accepter|aceptar todo) \| .*", r"by reading on you agree\.(?: ok)?", r"save selection|auswahl speichern|enregistrer|guardar",
    r"ok|verstanden|compris|entendido",
]) + ")$")
#: Side notes about scripts: that a page works better with them, or that its text does not need them.
_BETTER = re.compile(r"\b(?:better|mieux|mejor|besser)\b|flssiger")
_NO_NEED = re.compile("text does not|pas le texte|el texto no|der text nicht")
_GLUE = _words("""a an the this that these of one some and or to for from by on in at is are was were be been has have had it its not no nothing here there you your we our us
please sorry go start carrying if may can could would will when while again up with without before about after any more
der die das ein eine einen diese dieser dieses ihr ihre ihren ihres sie sich uns unser unsere wir ist sind wird wurde werden und oder um zu zum zur von für auf in im den dem des es da hier
kann haben hat nicht nichts kein keine mehr bitte leider ohne wegen neu später erneut bald zurück zurzeit bis etwas
le la les un une des du de ce cette ces votre vos notre nous vous que qui est sont a été à au aux et ou pour par dans sans pas plus plus tard n’a n’est n’avez avez l’accueil d’ merci désolé veuillez en
el los las una unos este esta estos su sus nuestro no se ha han ya y o que en con sin por favor para de del lo al más tarde sentimos gracias""")
_PAGE = _words("""page pages site website app application document file address adress link links start search content contents service server servers shop domain account session portal platform forum store tool system seite seiten angebot anwendung dokument adresse
startseite inhalt inhalte dienst sitzung server datenbank shop konto page site document l’adresse adresse lien contenu contenus service serveur session base boutique application serveur compte página sitio documento dirección enlace contenido contenidos
servicio servidor sesión base datos tienda aplicación inicio catalogue map menu gallery list table calendar karte katalog kalender catálogo mapa carte calendrier""")
_ERROR = _words("""error errors code id http internal bad gateway request requests wrong went failed failure forbidden unavailable found exist exists longer such nothing absent denied refused access allowed permission permitted rights view see
moved removed asked requested looking followed wanted expired timed out over sign log back come closed parked sale offline temporarily temporary planned work maintenance down suspended set yet minutes minute seconds second few try later too many slow your has been limited
connect connection connections database backend storage node timeout time reached finish complete handle informed something side happened unexpected fatal uncaught warning exception contact provider administrator webmaster check typing mistakes spelling matched perhaps helps instead date
available unavailable busy overloaded moment patience apologize inconvenience oops takes reload refresh
fehler serverfehler interner interne code zugriff verweigert berechtigung gefunden vorhanden existiert verfügbar erreichbar gesuchte angeforderte gewünschte schiefgegangen laden abgelaufen melden anmelden wartungsarbeiten wartung geduld
verbindung zeitüberschreitung versuchen prüfen zuviele anfragen schreibweise aufgerufene gelöscht verschoben zurück gehen verfügbar
erreur interne code accès refusé interdit autorisation droits nécessaires introuvable n’existe existe demandée recherchée cherchez déplacée supprimée survenue rechargez expiré reconnecter maintenance revenons bientôt patience
réessayer vérifiez retour connexion impossible délai dépassé indisponible disponible erreur trouvée momentanément requêtes
error interno código acceso denegado prohibido permiso tiene ver existe encuentra encontrada disponible pedida solicitada busca inexistente fallado algo recargue caducado entre nuevo iniciar sesión mantenimiento volvemos pronto paciencia
inténtelo conexión hay tiempo agotado revise momento temporalmente volver demasiadas solicitudes siguiente movida eliminada""")
_SCRIPT = _words("""javascript d’activer d’utiliser continuer continuar fortzufahren fortfahren weiter desactivado scripts script scripting noscript enable enabled disabled enabling turn turned switch switched activate allow allowed blocks blocked must need needs needed required requires use used using view open run runs work works load loading loaded just moment wait happens continue proceed display render
cookies browser browsers drawn stays empty checking verifying verify let supported outdated old out date install current one update upgrade human started
skripte skripten javascript aktivieren aktiviert einschalten schalten ein nutzen benutzen funktioniert angezeigt anzeigen zeigt braucht benötigt browser geprüft überprüft augenblick veraltet aktuellen unterstützt deaktiviert
javascript scripts activez activer activé afficher utiliser ouvrir fonctionne navigateur vérification instant trop ancien désactivé nécessaire requis patientez chargement ne
javascript scripts active activar habilitar habilite debe usar ver abrir funciona navegador comprobando verificando momento demasiado antiguo necesita requiere espere cargando permitir""")
_FILLER = _words("""lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure
blah abc asdf qwertz qwerty foo bar baz test xxx xxxx xxxxx yyy zzz hjkl
todo tbd fixme coming soon text texts copy intro introduction title titles heading headline description caption paragraph entry message layout fill space does teaser summary body subtitle quote box field goes added add type write describe replace publishing sample dummy placeholder filler meaning short tour product insert image picture
mustertext blindtext platzhalter beispieltext fülltext text texte satz fläche füllen prüfen bild beschreibung überschrift steht stehen titel absatz inhalt
texte titre paragraphe factice remplacer provisoire exemple d’exemple compléter insérer ici remplir maquette description légende image venir faux
texto título párrafo ejemplo muestra sustituir relleno ocupar espacio maqueta completar va aquí descripción imagen prueba""")
#: The closed vocabulary of sentences without information, and the words of it that make a sentence such a one.
LOW = _GLUE | _PAGE | _ERROR | _SCRIPT | _FILLER | MENU
STRONG = re.compile(r"""\b(?:error|errors|fehler|\w*serverfehler|erreur|http|forbidden|unavailable|gateway|bad\ request|denied|refused|refus|verweigert|denegado|prohibido|interdit
  | not\ found|no\ such|nothing\ (?:here|matched)|could\ not|couldnt|absent|inexistente|introuvable|nicht\ (?:gefunden|vorhanden|verf\w*|erreichbar|gefunden)|existiert|does\ not\ exist|no\ existe|nexiste|no\ se\ encuentra|no\ encontrada|no\ longer|no\ est\ disponible|ya\ no
  | been\ (?:moved|removed|limited|suspended)|not\ set\ up|dplace|supprime|eliminada|movida|went\ wrong|schiefgegangen|ha\ fallado|survenue|expired|expir|abgelaufen|caducado|timed\ out|time-?out|maintenance|wartung\w*|mantenimiento|offline|planned\ work|parked
  | too\ many\ requests|not\ allowed|permiso|berechtigung|droits\ ncessaires|(?:cannot|unable\ to|failed\ to)\ connect|keine\ verbindung|(?:no\ hay|sin)\ conexin|connexion\ .*\bimpossible|fatal|uncaught|out\ of\ date|be\ out\ of\ date
  | javascript|scripts?|scripting|skripten?|noscript|browser|navegador|navigateur|one\ moment|just\ a\ moment|please\ wait|loading
  | lorem|ipsum|dolor|adipiscing|consectetur|nostrud|blah|asdf|qwertz|foo|mustertext|blindtext|platzhalter|dummy|todo|tbd|coming\ soon|placeholder|filler|sample|goes\ here|(?:text|content|heading|headline|title|description|caption)\ (?:here|to\ be\ added)|in\ this\ (?:box|field)|your\ (?:text|content|heading|title|description)
  | hier\ steht|ihr\ text|factice|provisoire|votre\ texte|texte\ dexemple|titre\ complter|relleno|su\ texto|prrafo\ de\ ejemplo|ttulo\ por\ completar)\b""", re.X)
_TRACE = re.compile(r"^(?:fatal: uncaught .*|warning: \w+\(\).*|#\d+ .*|at \w[\w.$]*\(.*|traceback .*|file \S+, line \d+.*|notice: .*|in /\S+ on line \d+)$")
#: Numbers an error page gives for reference.
_CASE_ID = re.compile(r"^(?:reference|referencia|rfrence|referenz|fehlernummer|incident|error|request|vorgang)(?: (?:number|id|no|nummer|code|numro|nmero))?:? ?[\w-]*\d[\w-]*\.?$")
#: A note to whoever writes the page.
_TODO = re.compile(r"^(?:todo|tbd|fixme)(?:\W|$)")
#: A status line as servers send it, with their name behind it at most.
_STATUS = re.compile(r"^(?:http(?:/[\d.]+)? ?|error:? ?)?(?:" + "|".join(f"{int(c)}[ :,-]+{re.escape(c.phrase.lower())}" for c in HTTPStatus if c >= 400) + r")(?:\W+[\w./-]+){0,2}$")
_TITLE_END = re.compile(r"[.!?:;,]\s*$")


def _is_menu(sk: str) -> bool:
    words = re.findall(r"[a-z]+", sk)
    return bool(words) and all(w in MENU for w in words)


def _boilerplate(sk: str) -> bool:
    if script := re.search(r"\bjavascript\b", sk):
        if _BETTER.search(sk) or _NO_NEED.search(sk, script.end()):
            return True
    return bool(BOILERPLATE.match(sk)) or _is_menu(sk)


def level(sk: str) -> int:
    """2 a sentence that says an error, filler or script notice, 1 one of its vocabulary, 0 any other."""
    if _TRACE.match(sk):
        return 2
    words = re.findall(r"[a-z]+", sk)
    if not words:
        return 1 if not re.search(r"\d", sk) else 0
    if all(w in LOW or len(w) == 1 for w in words):
        return 2 if STRONG.search(sk) else 1
    if _TODO.match(sk) or _STATUS.match(sk):
        return 2
    return 1 if _CASE_ID.match(sk) else 0


def rest_of(text: str) -> list[tuple[str, bool]]:
    """What is left without menu, notices and footer: skeleton of each sentence, and whether it is the title.

    The title is the first line left, if it is no whole sentence and no known
    residue and more follows it.
    """
    out: list[tuple[str, bool]] = []
    for line in text.split("\n"):
        sk = skeleton(line)
        if not sk or _is_menu(sk):
            continue
        parts = [x for x in _SENTENCE.split(sk) if x and not _boilerplate(x)]
        if len(parts) == 1 and not out and not _TITLE_END.search(line) and level(parts[0]) != 2:
            out.append((parts[0], True))
        else:
            out += [(x, False) for x in parts]
    return [(out[0][0], False)] if len(out) == 1 else out


_DIGIT = re.compile(r"\d")


def template(sk: str) -> str:
    """A sentence with everything that holds a digit masked."""
    return " ".join("0" if _DIGIT.search(w) else w for w in sk.split(" ")) if _DIGIT.search(sk) else sk


def _key(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def _slug_words(url: str | None) -> set:
    try:
        path = unquote(urlsplit(url or "").path)
    except ValueError:
        path = url or ""
    return {w for w in re.findall(r"[a-z]{3,}", skeleton(path)) if w != "html"}


def take_apart(url: str | None, text: str, host: str | None = None) -> tuple[dict[str, int], str, bool, int]:
    """Templates of the body with their levels, what the page is about, whether the body speaks of that, and its words.

    About is the title, else the address's words, else host and address. A body speaks
    of it if a sentence without known residue has a word of title or slug.
    """
    title, body, words = "", {}, 0
    for sk, is_title in rest_of(text):
        if is_title:
            title = sk
            continue
        t, lv = template(sk), level(sk)
        body[t] = max(lv, body.get(t, 0))
        words += sk.count(" ") + 1
    slug = _slug_words(url)
    terms = slug | set(re.findall(r"[a-z]{3,}", title))
    own = any(not lv and any(w in t and re.search(rf"(?<![a-z]){w}(?![a-z])", t) for w in terms) for t, lv in body.items())
    return body, title or " ".join(sorted(slug)) or f"{host} {url}", own, words


_READ = "doc_id bigint, row bigint, host bigint, about bigint, field boolean, own boolean, words int, size int, strong boolean, t array<bigint>, lv array<tinyint>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64()), "array<tinyint>": pa.list_(pa.int8())}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _READ.split(", "))])
    row = TaskContext.get().partitionId() << 33
    for b in batches:
        rows = []
        for i, host, url, text in zip(*(b.column(k).to_pylist() for k in ("doc_id", "host", "url", "text"))):
            body, about, own, words = take_apart(url, text, host)
            rows.append((i, row, _key(host or ""), _key(about), shows_field(text), own, words, len(body), 2 in body.values(), list(map(_key, body)), list(body.values())))
            row += 1
        cols = list(zip(*rows)) if rows else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


#: A template is judged by the corpus from so many documents and titles or addresses on, and if on more than one host.
MIN_DOCS, MIN_ABOUTS = 3, 3
#: Words of a body for which it must be seen under one title or address more: copies of a page that says something are fewer than that.
WORDS_AN_ABOUT = 10
#: Share of a template's documents that must say nothing else, and documents added to them where it never stands beside known residue.
MIN_SHARE, DOUBT = 0.8, 2.0
#: Known residue is overruled from so many documents on, if less than that share of them says nothing else.
OVERRULED_DOCS, OVERRULED_SHARE = 5, 0.5


def read_texts(docs: DataFrame) -> DataFrame:
    """What the detectors see in each document with text, in one pass over whole texts; null and blank texts are left out."""
    ship(docs.sparkSession)
    d = docs.where(F.length(F.trim("text")) > 0).select("doc_id", F.lower("host").alias("host"), "url", "text")
    return d.mapInArrow(_read, _READ)


def _bare(seen: DataFrame, often: DataFrame) -> DataFrame:
    """Rows whose body holds nothing but frequent templates and known residue: row, doc_id, host, about, words, body (t, lv, n).

    Sentences are sent only where they are frequent or known, so of other rows
    little or nothing travels.
    """
    s = seen.where(~F.col("own") & (F.col("size") > 0) & ~F.col("field"))
    s = s.select("row", "doc_id", "host", "about", "words", "size", "strong", F.explode(F.arrays_zip("t", "lv")).alias("s"))
    s = s.select("row", "doc_id", "host", "about", "words", "size", "strong", F.col("s.t").alias("t"), F.col("s.lv").alias("lv"))
    s = s.join(often, "t", "left").where("n is not null or lv > 0")
    return s.groupBy("row", "doc_id", "host", "about", "words", "size", "strong").agg(F.collect_list(F.struct("t", "lv", "n")).alias("body")).where(F.size("body") == F.col("size"))


def residue(docs: DataFrame) -> DataFrame:
    """doc_id, reason of each document that shows a template field or has no real content.

    reason: 'field'; 'repeated', where the corpus alone shows every sentence to
    be residue; 'mixed', where it shows some and the others are of the known
    vocabulary; 'known', where all are. A template is residue by the corpus
    if it is in MIN_DOCS documents or more, these are on several hosts and under
    MIN_ABOUTS titles or addresses (more for longer bodies), and MIN_SHARE of
    them (with DOUBT) have no other sentence than such and known ones and none
    that shares a word with title or slug. Null and blank texts are no cases;
    repeated rows and ids are judged each by itself.
    """
    seen = materialize(read_texts(docs), "residue")
    often = seen.select(F.explode("t").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCS)
    bare = materialize(_bare(seen, often), "bare")
    # of those only rows none of whose sentences is bound to one host or to few titles and addresses
    each = bare.select("row", "host", "about", "strong", F.inline("body"))
    spread = [(F.min("host") < F.max("host")).alias("hosts"), F.count_distinct("about").alias("abouts")]
    bound = each.where("n is not null and lv = 0").groupBy("t").agg(*spread).where(~F.col("hosts") | (F.col("abouts") < MIN_ABOUTS)).select("t")
    rows = each.where("lv = 0").join(bound, "t", "left_semi").select("row").distinct()
    each = each.where("n is not null").join(rows, "row", "left_anti")
    stats = each.groupBy("t").agg(F.count(F.lit(1)).alias("bare"), F.max("n").alias("n"), F.max(F.col("strong") & (F.col("lv") == 0)).alias("near"), *spread)
    doubt = F.when(F.col("near"), 0.0).otherwise(DOUBT)
    shown = F.col("hosts") & (F.col("abouts") >= MIN_ABOUTS) & (F.col("bare") >= (F.col("n") + doubt) * MIN_SHARE)
    over = (F.col("n") >= OVERRULED_DOCS) & (F.col("bare") < F.col("n") * OVERRULED_SHARE)
    verdict = stats.select("t", F.when(shown, F.col("abouts")).alias("abouts"), over.alias("over")).where("abouts is not null or over")
    s = bare.select("row", "doc_id", "words", F.explode("body").alias("s")).select("row", "doc_id", "words", F.col("s.t").alias("t"), F.col("s.lv").alias("lv"))
    s = s.join(verdict, "t", "left")
    by_corpus = F.coalesce(F.col("abouts") >= MIN_ABOUTS + F.floor(F.col("words") / WORDS_AN_ABOUT), F.lit(False))
    by_words = (F.col("lv") > 0) & ~F.coalesce("over", F.lit(False))
    s = s.groupBy("row", "doc_id").agg(
        F.every(by_corpus | by_words).alias("all"), F.every(by_corpus).alias("repeated"), F.some(by_corpus).alias("some"), F.some(by_words & (F.col("lv") == 2)).alias("strong"))
    s = s.where(F.col("all") & (F.col("some") | F.col("strong")))
    empty = s.select("doc_id", F.when(F.col("repeated"), "repeated").when(F.col("some"), "mixed").otherwise("known").alias("reason"))
    return seen.where("field").select("doc_id", F.lit("field").alias("reason")).unionByName(empty)
