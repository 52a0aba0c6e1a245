"""Everyday pages that no rule or word of the vocabulary was written from: found and kept shares of at least nine in ten."""

from tessera.llm import residue

RESIDUE = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation.
Error establishing a database connection
Forbidden. You don't have permission to access /private/ on this server. Apache/2.4.41 (Ubuntu) Server at example.org Port 80
Seite nicht gefunden. Die von Ihnen gesuchte Seite existiert leider nicht.
Page non trouvée. La page que vous cherchez n'existe pas ou a été déplacée.
Página no encontrada. La página que busca no existe.
Just a moment... Verifying you are human. This may take a few seconds.
PHP Fatal error: Uncaught Error: Call to undefined function connect() in /var/www/html/index.php on line 12
This account has been suspended. Please contact your hosting provider.
503 Service Temporarily Unavailable. The server is temporarily unable to service your request due to maintenance downtime. Please try again later.
404 Not Found nginx/1.18.0
502 Bad Gateway
500 Internal Server Error. The server encountered an internal error and was unable to complete your request.
JavaScript is disabled in your browser. Please enable JavaScript to proceed.
You need to enable JavaScript to run this app.
This site requires cookies. Please turn on cookies in your browser settings and reload.
Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite nutzen zu können.
Veuillez activer JavaScript dans votre navigateur pour continuer.
Debe habilitar JavaScript en su navegador para usar esta aplicación.
Schakel JavaScript in om deze website te gebruiken.
Pagina niet gevonden. De gevraagde pagina bestaat niet meer.
Access Denied. You are not authorized to access this page.
Your session has timed out. Please log in again.
This site can't be reached. The connection was reset.
The requested URL was not found on this server.
410 Gone. The page you requested has been removed.
Oops! Something went wrong. Please refresh the page or try again.
Hello {{ first_name }}, thank you for joining {{ company_name }}.
Dear [Name], we are pleased to inform you that your order [Order Number] was sent on [Date].
Insert your text here. Click to edit this paragraph.
Your content goes here. Replace this text with your own.
Sehr geehrte Frau {nachname}, Ihr Termin am {datum} wurde bestätigt.
Bla bla bla, blindtext blindtext und noch mehr blindtext.
Dummy text dummy text dummy text. More dummy text and filler text.
Traceback (most recent call last): File "app.py", line 3, in <module> ValueError: invalid literal for int()
java.lang.NullPointerException at com.example.Main.run(Main.java:42) at com.example.Main.main(Main.java:10)
429 Too Many Requests. You have sent too many requests in a given amount of time.
Sorry, this video is no longer available.
The file you are looking for has been moved or deleted.
Wartungsarbeiten: Der Dienst ist vorübergehend nicht verfügbar. Bitte versuchen Sie es später noch einmal.
Erreur 500 : une erreur interne du serveur s'est produite. Veuillez réessayer plus tard.
Acceso denegado. No tiene permiso para ver esta página.
Please complete the security check to access the website. Are you a robot?
Your IP address has been blocked. Please contact the administrator.
This domain is not available. The website is under maintenance and will be back soon.
Could not connect to the database server. Connection refused.
We can't find the page you're looking for. Check the URL or go back to the home page.
${user.name} has shared ${document.title} with you
Title: <Insert title here> Author: <Insert author here>
De server is niet bereikbaar. Probeer het later opnieuw.
"""
REAL = """
If you see the message please enable JavaScript, activate it in the browser settings and load the page again. The steps differ between versions, and the handbook lists them for the four most common ones.
JavaScript is a programming language that runs in every common browser. It was created in ten days and is now standardised.
We measured how often crawlers meet broken links. Of two million addresses, four per cent answered with an error, most of them in old archives.
The server was moved to another building in spring. Since then the response times have halved, as the report shows.
Cookies are small files that a site stores on a visitor's machine. European law asks for consent before most of them may be set.
Lorem ipsum is a text that printers have used since the sixteenth century to show how a page will look.
The placeholder in the contract must be replaced by the buyer's name before both sides sign it.
Der Fehler trat erstmals im Herbst auf und konnte erst nach drei Wochen behoben werden. Die Ursache war ein defektes Kabel im Keller.
Die Seite des Museums zeigt Bilder aus vier Jahrhunderten. Besucher können sie auch abends ansehen.
Le serveur du laboratoire traite chaque nuit les images du télescope. Les résultats sont publiés au printemps.
La biblioteca abrió sus puertas en 1902 y conserva más de diez mil manuscritos de la región.
De bibliotheek bewaart oude kaarten van de stad. Bezoekers mogen ze op afspraak bekijken.
Access to clean water was denied to thousands of families during the drought, the committee found.
The committee found no record of the sale, and the heirs went to court in 1911.
Requests for comment were not answered. The company has until Friday to reply to the authority.
Our parser reports a syntax error with the place where it occurs, and tries to go on after it. We compare three ways of doing so on student programs.
The permission to build was withdrawn after the flood, and the site has been empty ever since.
A session lasts ninety minutes. Participants bring their own notebook and work in pairs.
He looked for the page on which the recipe was written, but it was gone.
The status of the species is uncertain: it was last seen in 1987 near the coast.
HTTP status codes are grouped by their first digit. Codes from 400 to 499 say that the client made a mistake, and 404 means that nothing was found under the address.
The study was suspended for two years because of a lack of money. It was taken up again in 2016.
Wer eine Datei löscht, kann sie oft wiederherstellen. Das Kapitel erklärt, wie Dateisysteme Blöcke freigeben.
Exceptions in this language are checked by the compiler. We argue that this makes interfaces clearer, though many programmers disagree.
The archive is open to readers on weekdays. Please bring a letter of introduction.
Template engines such as the ones compared here fill slots like {{name}} at run time. The fastest of them compiles its templates to byte code, which takes longer at first but pays after a few hundred pages.
The variable ${HOME} holds the user's folder. Shell scripts should quote it, because folders may have blanks in their names.
Maintenance of the bridge costs more than a new one would. The council will decide in May.
The door was locked, the key was gone, and nobody answered the telephone.
The link between diet and sleep is not well understood. Two trials are under way.
Two of the volumes are missing; a thief is thought to have sold them abroad.
The author is sorry for the delay and thanks the reviewers for their patience.
Robots that talk to people must know when they are not understood. We let twenty adults try three prototypes.
An unexpected result was that birds returned earlier after cold winters.
Bad gateways between networks were the main source of loss in early packet systems, as the interviews show.
Das Formular enthält Felder für Name und Anschrift. Es muss bis Ende März eingereicht werden.
Unavailable data are a common problem of meta-analyses. We wrote to 214 authors, and 61 sent their tables.
The timeout of the sensor is set to five seconds, so that the battery lasts a year.
The browser extension collects opinions on news articles. It was installed by 1,200 volunteers over six months.
The lost page of the chronicle could not be found in any library, yet its content is known from a copy.
Bienvenue dans notre ville. Le marché a lieu chaque samedi sur la place principale.
Fehlermeldungen sollen sagen, was zu tun ist. Wir untersuchen 300 Beispiele aus Bürosoftware und schlagen Regeln vor.
The team enables scripts in the simulator to drive the traffic lights. Their timing follows the counts of the previous week.
The connection of the two rivers was completed in 1889 and closed a century later.
After the password had expired, most people chose one that differed by a single digit.
The word error has several meanings in statistics. Here it means the difference between a measured and a true value.
Gone are the days when a telescope needed a person at its side all night.
Too many cooks spoil the broth, says the proverb; our data on open projects do not support it.
Le document décrit la procédure à suivre en cas d'incendie. Il est remis à chaque nouvel employé.
El informe describe los daños del terremoto y propone medidas para las escuelas.
"""


def lines(block: str) -> list[str]:
    return [line for line in block.splitlines() if line.strip()]


def test_unseen_pages():
    finder = residue.Finder()
    missed = [t for t in lines(RESIDUE) if finder.measure(t)[0] < residue.THRESHOLD]
    wrong = [t for t in lines(REAL) if finder.measure(t)[0] >= residue.THRESHOLD]
    found = len(lines(RESIDUE)) - len(missed)
    assert found >= 0.9 * len(lines(RESIDUE)) and found >= 0.9 * (found + len(wrong))
