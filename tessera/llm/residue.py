"""Problem 9: find records that hold unfilled template, filler, error pages or demands for scripts in place of content.

A multi-pattern automaton finds the vocabulary of such records in five languages, by class: what fails, how it fails,
advice that follows, what is to be switched on, slots to be filled. A sentence is residue when classes that make up a
message meet in it and its other content words are few; placeholders are verified by their whole form; sentences of
filler words count as a whole. A record is excluded when residue covers the main part of it, menus and headings aside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import widen

#: Share of a record, or of its sentences, that is its main part.
THRESHOLD = 0.5
#: Least share of a sentence's content words, by letters, that the vocabulary must explain; demands often follow a title.
COVERED, COVERED_DEMAND = 0.5, 0.3
#: Least share of a sentence that placeholders must hold, and where a record has several.
SLOT, SLOTS = 0.2, 0.06

#: By class, the vocabulary of pages in place of content; a bar separates entries.
VOCABULARY = {
    # what something happens to
    "subject": """
page|pages|site|website|web site|document|file|files|folder|directory|url|resource|record|link|article|paper|full text|attachment|pdf|image|server|servers|service|application|account|session|content|volume
archive|database|connection|request|requests|address|host|gateway|proxy|database server|domain|download|view|query|viewer|reader|identifier|permission|access|object|item|entry|login|ip address|you are looking for
seite|webseite|internetseite|dokument|datei|adresse|verzeichnis|datensatz|verweis|artikel|beitrag|volltext|anlage|band|dienst|konto|sitzung|inhalt|inhalte|archiv|datenbank|verbindung|anfrage|anfragen|anforderung
gutachtenseite|ansicht|beitragsansicht|anwendung|zugriff|domain|beitragsnummer|ressource
la page|page|le site|site|document|fichier|adresse|lien|notice|volume|texte intégral|pièce jointe|serveur|service|compte|session|contenu|base de données|connexion|requête|ressource|accès
página|pagina|sitio|documento|archivo|dirección|enlace|registro|volumen|texto completo|anexo|servidor|servicio|cuenta|sesión|contenido|base de datos|conexión|solicitud|recurso|acceso
webpagina|bestand|adres|koppeling|dienst|verbinding|inhoud|aanvraag|toegang|sessie|bron|artikel
""",
    # how it fails
    "failure": """
not found|was not found|were not found|could not be found|couldn't be found|cannot be found|can't be found|can not be found|could not find|couldn't find|cannot find|can't find|unable to find|unable to locate|could not locate|could not be located
does not exist|doesn't exist|do not exist|no longer exists|never existed|no longer available|is not available|isn't available|not available|currently unavailable|temporarily unavailable|is unavailable|be unavailable|unavailable|unreachable|not reachable|not responding|did not respond|took too long
has been moved|been moved|been removed|been deleted|has been withdrawn|withdrawn|renamed|moved or deleted|been suspended|is suspended|suspended|been disabled|been blocked|is blocked|been locked|is locked|been banned|been restricted|been terminated
timed out|time out|timeout|could not be loaded|couldn't load|failed to load|could not load|could not be displayed|cannot be displayed|can't be displayed|cannot be shown|could not be opened|cannot open|could not connect|unable to connect|can't connect|can't reach|could not reach|cannot reach|refused to connect|connection refused|connection reset|failed to open|failed to connect|could not be established
has expired|expired|access denied|permission denied|access is denied|is denied|was denied|denied|not permitted|not allowed|not authorized|not authorised|don't have permission|do not have permission|may not be viewed|no permission|forbidden|unauthorized|is restricted
something went wrong|went wrong|gone wrong|unexpected error|an error occurred|an error has occurred|error occurred|encountered an error|problem occurred|cannot be processed|could not be processed|could not process|unable to process|unable to complete|could not be completed|down for maintenance|under maintenance|undergoing maintenance|scheduled maintenance|is down
too many|quota exceeded|limit exceeded|exceeded|invalid|malformed|no results|no record matches|matches your query|match your search|by another session
nicht gefunden|nicht auffinden|nicht aufgefunden|existiert nicht|existiert nicht mehr|gibt es nicht|nicht vorhanden|nicht mehr verfügbar|nicht verfügbar|nicht erreichbar|nicht geladen|nicht angezeigt|nicht dargestellt|nicht geöffnet|nicht verarbeitet|nicht hergestellt|nicht eingesehen|verschoben|gelöscht|entfernt|umbenannt|zurückgezogen|gesperrt|blockiert|abgelaufen|verweigert|abgelehnt|schiefgegangen|schiefgelaufen|schief gelaufen
keine berechtigung|fehlt ihnen die berechtigung|nicht berechtigt|zeitüberschreitung|ungültig|ungültige|ungültiger|zu viele|gewartet|wartungsarbeiten|liegt kein|kein treffer|ein fehler ist aufgetreten|fehler aufgetreten|unerwarteter fehler|überschritten|durch eine andere sitzung
introuvable|n'existe pas|n'existe plus|n'a pas été trouvée|n'a pas été trouvé|non trouvée|non trouvé|pas trouvé|pas trouvée|n'est plus disponible|n'est pas disponible|indisponible|inaccessible|déplacée|déplacé|supprimée|supprimé|n'a pas pu être|n'a pas pu|expiré|refusé|refusée|accès interdit|interdit|est survenue|s'est produite|suspendu|bloqué|en maintenance|trop de|impossible d'afficher|impossible de
no encontrada|no encontrado|no se encontró|no se encuentra|no se ha encontrado|no existe|ya no existe|ya no está disponible|no está disponible|no disponible|no está accesible|inaccesible|ha sido movida|ha sido eliminada|ha sido eliminado|eliminado|no se pudo|no se puede|no ha podido|ha caducado|caducado|denegado|prohibido|ha ocurrido|se ha producido|suspendida|suspendido|bloqueado|en mantenimiento|demasiadas
niet gevonden|bestaat niet|bestaat niet meer|niet beschikbaar|niet meer beschikbaar|onbereikbaar|niet bereikbaar|verplaatst|verwijderd|kon niet worden|kan niet worden|verlopen|geweigerd|verboden|is opgetreden|ging iets mis|iets misgegaan|geblokkeerd|opgeschort|in onderhoud|te veel|niet toegestaan|geen toegang
""",
    # names of faults
    "reason": """
bad request|payment required|method not allowed|not acceptable|proxy authentication required|request timeout|length required|precondition failed|payload too large|uri too long|unsupported media type|range not satisfiable|expectation failed|unprocessable entity|too many requests|internal server error|server error|not implemented|bad gateway|service unavailable|gateway timeout|gateway time-out|http version not supported|insufficient storage|network authentication required
page not found|file not found|error 404|404 error|application error|runtime error|fatal error|parse error|syntax error|database error|error establishing a database connection|internal error|general error|critical error|connection error|network error|script error|configuration error|uncaught exception|unhandled exception|stack trace|stacktrace|traceback (most recent call last)|segmentation fault|out of memory|memory exhausted|null pointer|access violation|undefined index|undefined variable|call to undefined function
interner serverfehler|interner fehler|schwerwiegender fehler|serverfehler|seite nicht gefunden|datenbankfehler|zugriff verweigert|anwendungsfehler|verbindungsfehler
erreur interne|erreur du serveur|erreur serveur|page introuvable|page non trouvée|accès refusé|erreur fatale|erreur de connexion|erreur de base de données
error interno|error del servidor|página no encontrada|acceso denegado|error fatal|error de conexión|error de base de datos
interne serverfout|serverfout|pagina niet gevonden|toegang geweigerd|fatale fout|databasefout|verbindingsfout
""",
    # marks around a fault
    "label": """
error|error code|errors|http|https|status|status code|code|oops|whoops|sorry|uh oh|notice|warning|incident|request id|reference id|ray id|reference number|seconds|minutes|retry after|exception|errno|apache|nginx|iis|tomcat|cloudflare|varnish|openresty|litespeed|port|unfortunately|problem
fehler|fehlercode|fehlermeldung|hoppla|leider|hinweis|vorgang|sekunden|minuten|verzeihung|entschuldigung|ups
erreur|désolé|désolés|oups|secondes|code d'erreur|lo sentimos|disculpe|vaya|incidencia|código de error|segundos|fout|foutcode|helaas|foutmelding|seconden
""",
    # what is advised then
    "advice": """
try again|please try|again later|later|in a few minutes|go back|return to|back to|start a new search|home page|homepage|check the spelling|check the address|check the url|check your|spelling|contact the|contact us|contact your|administrator|webmaster|support|technical support|customer service|if the problem persists|problem persists|if you think|if you believe|this is a mistake|sign in again|sign in|log in|log in again|refresh|reload|reload the page|looking for|you requested|requested|you asked for|apologize|apologise|inconvenience|we are working|be back|back soon|check back|typed|mistyped|search box|clear your
versuchen sie|später erneut|später noch einmal|erneut|noch einmal|zurück zur|wenden sie sich|prüfen sie|überprüfen sie|schreibweise|administrator|bei wiederholung|melden sie sich|startseite|angeforderte|angeforderten|gesuchte|gesuchten|ihrer anfrage|in kürze|unannehmlichkeiten|laden sie
réessayez|réessayer|veuillez réessayer|plus tard|retour à|retournez|vérifiez|reconnecter|reconnectez|contactez|administrateur|demandé|demandée|recherchez|que vous cherchez|gêne occasionnée|quelques minutes
inténtelo|intente|de nuevo|más tarde|vuelva a|volver a|compruebe|verifique|inicie sesión|póngase en contacto|administrador|solicitado|solicitada|que busca|unos minutos|disculpe las molestias
probeer|probeer het|later opnieuw|opnieuw|ga terug|terug naar|controleer|neem contact|beheerder|gevraagde|die u zoekt|over enkele minuten|excuses voor het ongemak
""",
    # switching on, and what
    "switch": """
enable|enabled|turn on|turned on|switch on|switched on|activate|activated|allow|disabled|turned off|switched off|blocked|requires|require|required|needs|need|you need|you must|must|without|doesn't support|does not support|not supported|unsupported|upgrade|to continue|to view|is needed|is required|does not work|doesn't work|cannot work|will not work|won't work|loaded dynamically
aktivieren|aktiviert|einschalten|schalten sie|erlauben|erlaubt|deaktiviert|abgeschaltet|benötigt|benötigen|erfordert|funktioniert nicht|ohne|um fortzufahren|zum weiterlesen|muss|anzuzeigen|nachgeladen|unterstützt
activer|activez|activé|autorisez|autoriser|désactivé|désactivés|nécessite|exige|requiert|sans|pour continuer|pour afficher|ne fonctionne pas|prendre en charge
activar|active|active el|habilite|habilitar|permita|permitir|desactivado|desactivados|requiere|necesita|sin|para continuar|para ver|no funciona|es necesario
inschakelen|schakel|ingeschakeld|sta toe|toestaan|uitgeschakeld|vereist|nodig|zonder|om door te gaan|werkt niet
""",
    "script": """
javascript|java script|js|scripts|scripting|script execution|active scripting|active content|client-side code|cookies|cookie|adobe flash|flash player|webgl|skripte|skripten|skriptausführung|aktive inhalte|skript|scripts actifs|code actif|contenu actif|código activo|contenido activo|scripts activos|actieve inhoud
""",
    "browser": """
browser|browsers|your browser|web browser|browser settings|modern browser|noscript|browsereinstellungen|navigateur|navegador|ad blocker|adblocker
""",
    "setting": """
settings|security settings|einstellungen|sicherheitseinstellungen|paramètres|configuración|instellingen|extension
""",
    # pages that stand before another one
    "check": """
checking your browser|verifying you are human|verify you are human|verify that you are human|you are human|not a robot|are you a robot|just a moment|security check|ddos protection|captcha|complete the security check|unusual traffic|ihr browser wird geprüft|sicherheitsüberprüfung|kein roboter|ein mensch sind|vérification de votre navigateur|vérifier que vous êtes humain|pas un robot|comprobando su navegador|verificando que es humano|no soy un robot|controleren of u een mens bent|geen robot
""",
    # slots to be filled by hand
    "fill": """
insert|replace|write|enter|type|add|put|fill in|edit|paste|delete|change|todo|tbd|fixme|goes|write at most|choose|select|describe|provide
einfügen|ersetzen|schreiben|eintragen|ergänzen|ausfüllen|eingeben|hier steht|beschreiben|löschen|ersetzen sie|fügen sie|geben sie|tragen sie
insérez|insérer|remplacez|remplacer|écrivez|saisissez|ajoutez|se place|complétez|décrivez|inserte|sustituya|escriba|introduzca|añada|reemplace|aquí va|complete|describa|voeg|vervang|schrijf|vul|typ|voer
""",
    "slot": """
here|your text|your title|your name|your own|your contribution|your section|your company|your email|your content|your abstract|this paragraph|this box|this text|this section|this sentence|placeholder|placeholder copy|placeholder text|sample text|sample sentence|sample paragraph|dummy text|example text|default text|boilerplate|firstname|lastname|first name|last name|name of institute|name of institution|heading of your section|show the font|before printing|your logo|click to edit|subtitle
hier|ihren text|ihres beitrags|ihr text|ihr titel|ihres abschnitts|diesen absatz|diesen text|dieses feld|diesem feld|platzhalter|platzhaltertext|mustertext|mustersatz|beispieltext|blindtext|vorname|nachname|name des instituts|überschrift des abschnitts|der schrift|vor dem druck
ici|votre texte|votre titre|votre nom|votre contribution|ce paragraphe|ce texte|texte d'exemple|faux texte|prénom|nom de l'institut|titre de la section
aquí|su texto|su título|su nombre|su contribución|este párrafo|este texto|texto de ejemplo|texto de relleno|apellido|nombre del instituto|título de la sección
uw tekst|uw titel|uw naam|deze alinea|deze tekst|voorbeeldtekst|voornaam|achternaam
""",
    # what a slot is for; counts beside an order to fill it
    "field": """
summary|introduction|words|template|heading|section|title|abstract|name|text|überschrift|kurzfassung|einleitung|wörter|vorlage|abschnitt|abschnitts|titel|titre|résumé|mots|título|resumen|palabras|titel|samenvatting|woorden
""",
}

#: Words before a phrase that is spoken of, not shown.
MENTIONS = """
the message|a message|messages|error message|error messages|says|saying|say|reads|reading|if you see|when you see|you will see|shows the|displays|displayed the|returned|returns|responds|responded|logged|logs|recognises|recognizes|detects|marked as|known as|so-called|called
die meldung|meldungen|der meldung|fehlermeldungen|die aufschrift|den hinweis|die worte|lautet|lauten|zeigt die|erscheint|anzeigt|protokolliert|sogenannte|erkennt
le message|messages|indique|affiche|affichent|signale|el mensaje|mensajes|indica|muestra|muestran|dice|de melding|meldingen|toont|luidt
"""

#: Menus of pages, which are neither content nor residue.
MENUS = """
home|start|startseite|accueil|inicio|volumes|bände|volúmenes|search|suche|recherche|búsqueda|zoeken|help|hilfe|aide|ayuda|about|about us|contact|kontakt|contacto|login|sign in|anmelden|privacy|privacy policy|datenschutz|impressum|imprint|terms|terms of use|nutzungsbedingungen|conditions|sitemap|menu|menü|faq|english|deutsch|français|español
back to the start page|back to start|contact the library desk|zurück zur startseite|auskunft der bibliothek|retour|retour à l'accueil|volver|volver al inicio|skip to content|blog|news|register|subscribe|share|print|next|previous
"""

#: Words that filler consists of; the Latin ones are those of the usual typesetter's text.
FILLER = {
    "la": """lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi
    aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
    arcu congue felis lectus ligula mauris odio porta rutrum sapien tempus turpis vitae vel at nec ac orci vestibulum ante primis faucibus luctus ultrices posuere cubilia curae donec pellentesque habitant morbi tristique senectus netus
    malesuada fames egestas proin pharetra nonummy pede suspendisse aenean cras curabitur etiam fusce integer maecenas nam nullam nunc phasellus praesent quisque sagittis semper ullamcorper vivamus viverra volutpat tortor justo a""",
    "de": "bla blubb blindtext fülltext mehr muster noch text und wort platzhalter",
    "en": "again bar blah dummy filler foo more sample text word and placeholder baz qux asdf xxx test testing",
}

#: Words that carry no content, of five languages.
EMPTY = frozenset("""
a an the this that these those it its is are was were be been has have had do does did not no or and but if then than as at by for from in into of on to with without you your we our us i he she they them their there here please may might can could will would should while when which some
der die das den dem des ein eine einen einem einer eines ist sind war wurde wurden wird werden hat haben nicht kein keine und oder aber wenn dann als an auf aus bei für von vor in im ins mit ohne nach zu zum zur sie ihr ihre ihren ihrem ihrer wir uns es er bitte kann können diese dieser dieses diesen diesem dafür
le la les un une des du de est sont été a ont ne pas plus et ou mais si à au aux par pour dans sur avec sans vous votre vos nous notre ce cette ces il elle que qui s'il veuillez puis y en
el los las una unos del es son fue ha han sin y o pero a al para en con su sus nosotros este esta estos se lo que por favor
het een is zijn was werd niet geen en of maar als dan bij voor van in op aan met zonder naar te u uw wij ons deze dit dat die er
""".split())

#: Openings of placeholders, and the whole forms they must belong to.
OPENINGS = ("{{", "{%", "${", "<<", "<%", "[[", "%(", "@@", "##", "__", "&lt;", "«", "{row[", "[", "<", "%", "{", "(")
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|\$\{[^{}\n]{1,60}\}|<<[^<>\n]{1,60}>>|<%=?[^%\n]{1,60}%>|\[\[[^\[\]\n]{1,60}\]\]|%\([^()\n]{1,40}\)s"
    r"|@@[^@\n]{1,40}@@|##[^#\n]{1,40}##|__[^\W\d][^_\n]{0,40}__|&lt;[^&\n]{1,40}&gt;|«[^\W\d][\w ]{0,40}»|\{row\[[^\]\n]{1,40}\]\}"
    r"|\[(?:insert|enter|your|hier|bitte|add|todo|insérer|insertar|uw)\b[^\[\]\n]{1,60}\]|\[[^\[\]\n]{1,40} (?:goes here|here|folgt|eintragen|ici|aquí|hier)\]|<(?:your|insert|enter) [^<>\n]{1,40}>|<[^<>\n]{1,40} (?:eintragen|here|folgt)>"
    r"|\([^()\n]{1,40} (?:folgt|follows)\)|%[^\W\d][\w ]{0,30}%|\{[^\W\d][\w.]{2,30}\}|\[(?:company|client|customer|first|last|full)? ?(?:name|date|title|address|city|email)\]"
)
#: Lines of a program's trace.
TRACE = re.compile(r"""\s*(?:file "[^"\n]+", line \d+.*|at [\w$.]+\([\w.:$]+\).*|\w*(?:error|exception)(?: \w+)?: .*|(?:php )?(?:fatal error|parse error|warning|notice): .* on line \d+.*|.* in /[\w/.-]+ on line \d+.*|[\w.]+exception\b.*)$""")
_STATUS = re.compile(r"\b[45]\d\d\b")
_UNIT = re.compile(r"[^\n]*?(?:[.!?;](?=\s)|\n|$)")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_EDGE = re.compile(r"\w")


#: Classes one of which a sentence of residue has.
CORE = frozenset(("failure", "reason", "label", "advice", "check", "script", "browser", "slot", "fill"))


def _quoted(unit: str, start: int, stop: int) -> bool:
    before = unit[start - 1] if start else ""
    return before in ("“", "„", "«", "‹", "‘", '"') and before != "" or stop < len(unit) and unit[stop] in "”»›"


def _phrases(block: str) -> list[str]:
    return [p.strip() for p in re.split(r"[|\n]", block) if p.strip()]


def build_automaton():
    """Aho-Corasick automaton of the vocabulary and the placeholder openings; a value is (classes, length)."""
    import ahocorasick

    classes: dict[str, set[str]] = {}
    for kind, block in (*VOCABULARY.items(), ("mention", MENTIONS), ("menu", MENUS)):
        for phrase in _phrases(block):
            classes.setdefault(phrase, set()).add(kind)
    for opening in OPENINGS:
        classes.setdefault(opening, set()).add("open")
    machine = ahocorasick.Automaton()
    for phrase, kinds in classes.items():
        machine.add_word(phrase, (frozenset(kinds), len(phrase)))
    machine.make_automaton()
    return machine


class Finder:
    def __init__(self):
        self.machine = build_automaton()
        self.filler = [frozenset(words.split()) for words in FILLER.values()]

    def matches(self, low: str) -> tuple[list[tuple[int, int, frozenset[str]]], list[tuple[int, int]]]:
        """(matches of whole words in order of their start, longest first; verified placeholders)."""
        found, slots = [], []
        for end, (kinds, size) in self.machine.iter(low):
            start, stop = end - size + 1, end + 1
            if "open" in kinds:
                match = PLACEHOLDER.match(low, start)
                if match:
                    slots.append((start, match.end()))
                continue
            if start and _EDGE.match(low, start - 1) and _EDGE.match(low, start) or stop < len(low) and _EDGE.match(low, stop) and _EDGE.match(low, stop - 1):
                continue
            found.append((start, stop, kinds))
        found.sort(key=lambda f: (f[0], f[0] - f[1]))
        return found, slots

    def unit_kind(self, unit: str, own: list[tuple[int, int, frozenset[str]]]) -> tuple[str | None, bool]:
        """(kind of residue or None, whether it stands by itself) of one sentence or line."""
        if ("line " in unit or ":" in unit or "exception" in unit or "(" in unit) and TRACE.match(unit):
            return "error", True
        kinds: set[str] = set()
        covered = bytearray(len(unit))
        mention = len(unit)
        for start, stop, found in own:
            if "mention" in found:
                mention = min(mention, start)
                continue
            if start >= mention or _quoted(unit, start, stop):
                continue
            kinds |= found
            covered[start:stop] = b"\1" * (stop - start)
        status = bool(_STATUS.search(unit))
        if not kinds & CORE and not status:
            return None, False
        known = rest = 0
        for word in _WORD.finditer(unit):
            if covered[word.start()]:
                known += len(word.group())
            elif word.group() not in EMPTY:
                rest += len(word.group())
        share = known / (known + rest) if known + rest else float(status)
        demand = "check" in kinds or "script" in kinds and ("switch" in kinds or "failure" in kinds) or "browser" in kinds and "switch" in kinds
        if demand and share >= COVERED_DEMAND:
            return "script", True
        if share < COVERED:
            return None, False
        beside = {"subject", "label", "advice"} & kinds
        if "reason" in kinds or "failure" in kinds and (beside or rest == 0 or status) or status and (not rest or "label" in kinds):
            return "error", True
        if "fill" in kinds and ("slot" in kinds or "field" in kinds) or "slot" in kinds and known >= 2 * rest and known >= 12:
            return "template", True
        return ("error", False) if kinds & {"advice", "label", "failure"} else (None, False)

    def is_filler(self, unit: str) -> bool:
        words = unit.split()
        if len(words) < 3:
            return False
        bare = [w.strip(".,;:!?()") for w in words[:4]]
        if not any(w in f for w in bare for f in self.filler):
            return False
        words = _WORD.findall(unit)
        return len(words) >= 3 and any(sum(w in f for w in words) >= 0.8 * len(words) for f in self.filler)

    def measure(self, text: str) -> tuple[float, str | None]:
        """(share of the record that is residue, by characters or by sentences, and the kind with most of it)."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer would move the places
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found, slots = self.matches(low)
        filled = bytearray(len(low))
        apart, reached = 0, 0
        for start, stop in sorted(slots):
            filled[start:stop] = b"\1" * (stop - start)
            apart, reached = apart + (start >= reached), max(reached, stop)
        total, units, soft, soft_units = 0, 0, 0, 0
        sums = dict.fromkeys(("error", "script", "template", "filler"), 0)
        counts = dict(sums)
        at, last = 0, len(found)
        for match in _UNIT.finditer(low):
            begin, end = match.span()
            unit = match.group()
            size = len("".join(unit.split()))
            if not size:
                continue
            own, letters = [], 0
            while at < last and found[at][0] < end:
                start, stop, kinds = found[at]
                at += 1
                if stop <= end:
                    own.append((start - begin, stop - begin, kinds))
                    letters += stop - start
            held = sum(filled[begin:end]) if slots else 0
            kind, alone = None, True
            if held and held >= (SLOTS if apart > 1 else SLOT) * size:
                kind = "template"
            elif own and not held and self._menu(unit, own):
                continue
            elif self.is_filler(unit):
                kind = "filler"
            elif letters * 5 >= size or ":" in unit or size < 12:  # with less, the vocabulary cannot hold the share it must
                kind, alone = self.unit_kind(unit, own)
            if not (kind and alone) and not held and size < 90 and unit.rstrip()[-1:] not in (".", "!", "?", ";"):
                continue  # a heading
            total += size
            units += 1
            if kind and alone:
                sums[kind] += size
                counts[kind] += 1
            elif kind:
                soft += size
                soft_units += 1
        if sums["error"] or sums["script"]:  # advice counts beside a message only
            sums["error"] += soft
            counts["error"] += soft_units
        whole = sum(sums.values())
        if not whole:
            return 0.0, None
        return max(whole / total, sum(counts.values()) / units), max(sums, key=lambda k: sums[k])

    @staticmethod
    def _menu(unit: str, own: list[tuple[int, int, frozenset[str]]]) -> bool:
        """Entries of a menu hold nearly all letters of the line, which ends no sentence."""
        if unit.rstrip()[-1:] in "!?":
            return False
        covered = bytearray(len(unit))
        for start, stop, kinds in own:
            if "menu" in kinds:
                covered[start:stop] = b"\1" * (stop - start)
        letters = [i for i, c in enumerate(unit) if c.isalpha()]
        return bool(letters) and sum(covered[i] for i in letters) >= 0.85 * len(letters)


def mark_residue(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, residue, kind, excluded) for every row: share of residue, its main kind, and whether the record goes.

    Null and blank texts hold neither content nor residue: share 0, kept. Whole texts are read, in one pass.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for batch in batches:
            measured = [finder.measure(t) if t else (0.0, None) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "residue": [m[0] for m in measured], "kind": [m[1] for m in measured]})

    found = widen(documents.select("doc_id", "text")).mapInPandas(run, "doc_id long, residue double, kind string")
    return found.withColumn("excluded", F.col("residue") >= threshold)
