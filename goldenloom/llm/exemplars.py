"""Labelled exemplars of template residue, filler, error pages and script notices.

Each is (kind, text); alternatives of one phrase stand in one exemplar.
"{{gap}}" stands for an open gap of any notation.
"""

_TEMPLATE = """
Dear {{gap}}, your contact address is {{gap}}; please tell us by {{gap}} if it has changed. Thank you for registering {{gap}} as a supplier. Your tax number {{gap}} was accepted on {{gap}}. Reference {{gap}} stays valid for all mail from {{gap}}. Kind regards, {{gap}}, supplier desk in {{gap}}
Dear {{gap}}, thank you for your order {{gap}}. Your invoice {{gap}} is due on {{gap}}. Please contact {{gap}} with any questions. Yours sincerely, {{gap}}, {{gap}}
Guten Tag {{gap}}, Ihr Zeichen lautet {{gap}}. Die Anmeldung von {{gap}} ist eingegangen, Steuernummer {{gap}}, Datum {{gap}}. Bitte bestätigen Sie die Adresse {{gap}} bis zum {{gap}}. Mit freundlichen Grüßen, {{gap}}, Einkauf {{gap}}
Sehr geehrte Damen und Herren {{gap}}, vielen Dank für Ihre Bestellung {{gap}} vom {{gap}}. Mit freundlichen Grüßen {{gap}}
Bonjour {{gap}}, votre référence est {{gap}}. L'inscription de {{gap}} est enregistrée sous le numéro {{gap}} depuis le {{gap}}. Merci de confirmer l'adresse {{gap}} avant le {{gap}}. Cordialement, {{gap}}, service achats de {{gap}}
Hola, {{gap}}: su referencia es {{gap}}. El alta de {{gap}} consta con el número fiscal {{gap}} desde el {{gap}}. Confirme la dirección {{gap}} antes del {{gap}}. Un saludo, {{gap}}, compras de {{gap}}
Name: {{gap}}
Company: {{gap}}
Tax id: {{gap}}
City: {{gap}}
Address: {{gap}}
Phone: {{gap}}
Firma: {{gap}}
"""

_FILLER = """
Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum erat justo nunc porta vitae
asdf asdfgh sdfg dfgh qwer qwert qwerty qwertz jkl jklö hjkl yxcv zxcv zxcvbn xx blah bla and so on, etc. Test record, please ignore. Testing test, delete me. Body text. Lead text. Paragraph text goes in here. Heading one. Title one. Subtitle. Your text here. Our slogan here. Your story here. Add a second paragraph here. TODO FIXME TBD to do: describe this company, write something about the site, ask marketing. Description coming soon, to follow, to be added. Company profile goes here. Product text. Short summary. Insert a few, two or three sentences on products, sites, history, certificates in this box. Placeholder dummy sample example filler stand-in copy text for this section, for the profile, product list, category page; please replace, not for release, to be written later. Replace it, swap in, overwrite with a description of the supplier, product.
Type your text here. Enter some text here. Click here to edit this text. Replace this text
Das ist ein Blindtext für die Seite, bitte ersetzen. Dies ist ein Fülltext für das Profil, bitte überschreiben. Dies ist ein Platzhaltertext. Mustertext Musterzeile bitte löschen. Beispieltext. Hier steht später, noch, demnächst ein Text über den Lieferanten, das Produkt, die Firma. Beschreibung folgt in Kürze. Firmenprofil folgt. Text folgt. Produkttext folgt. Ihr Text hier
Votre texte ici. Insérez, saisissez, ajoutez votre texte ici. Texte provisoire, à remplacer avant publication. Texte de remplissage, à compléter avant mise en ligne. Texte factice. Faux texte. Description à venir. Fiche à rédiger. Présentation à venir.
Su texto aquí. Escriba, inserte, añada su texto aquí. Texto de relleno, sustituir antes de publicar. Texto de muestra, reemplazar antes de subir la ficha. Texto provisional. Descripción pendiente. Ficha por redactar. Presentación pendiente.
"""

_ERROR = """
HTTP/1.1 HTTP Error Status Server error 404: Page Not Found. 403 - Forbidden. 401 Unauthorized. 400 Bad Request. 410 Gone. 500 Internal Server Error. 502 Bad Gateway. 504 Gateway Timeout. 503 Service Unavailable. 429 Too Many Requests. 408 Request Timeout
{"code": 503, "error": "Service Unavailable", "detail": "Gateway Timeout, Bad Gateway, Not Found, Bad Request, Forbidden, Unauthorized, Gone, Too Many Requests, Internal Server Error", "status": 3, "message": "failed", "path": "/suppliers/3", "request_id": "3"}
Request rejected by the firewall. If you think this is a mistake give the code to the site owner.
The page you followed could not be found on this server. The page you asked for. The record you followed. The document you requested was moved or deleted. The page you requested is not available here any more. The file could not be found.
This supplier page does not exist yet. This customer page does not exist any more. This profile page does not exist in this region.
The service is temporarily unavailable. The portal is offline. This site is down for planned maintenance. Master data search is down. Expected end
We will be back shortly. Come back later. Try again later. Please try again in a few minutes.
Oops! Whoops! Hm, something went wrong while loading this page. Sorry, something failed while opening this profile. We are sorry, something broke while rendering this supplier.
Nothing here. Not allowed. Request blocked. Request refused. Please reload. Reload the page.
Access denied. Permission denied. You do not have permission to open this page. You are not authorised to view this record. You lack the rights to read this supplier. Not authorized
Your session has expired. Your login has timed out. Your access token has ended. Please sign in again to continue. Log in once more to go on. Sign in to see this record.
Too many requests from your address. Too many requests from your account. Slow down before you retry. Wait a moment before you retry. Wait 30 seconds before you retry. Retry in 30 seconds.
Could not connect to the database (errno 2). Could not open the file store. Could not reach the search index. The query was not run. The request was not run.
A service behind this page returned no data. The backend closed the connection. The upstream server did not answer in time.
Exception in thread "main" java.lang.NullPointerException at portal.Page(line 3). Fatal error in thread "main" OutOfMemory at mdm.export.Writer(line 3)
Traceback (most recent call last): File "app/views.py", line 3, in main
File "sync/job.py", line 3, in load. File "portal/render.py", line 3, in show
TypeError: NoneType has no len(). KeyError: 'profile'. TimeoutError. ValueError. AttributeError
doc = store[key] row = fetch(ref)
Warning: include(): failed to open stream in index.php on line 3. Warning: fopen(): failed opening required file in /srv/portal/page.php on line 3. Warning: mysql_connect(): failed with error 3
Incident. Error reference. Trace id.
Fehler 404: Die Seite wurde nicht gefunden. HTTP-Fehler 404: Die Datei existiert nicht. Statuscode 410: Das Dokument ist umgezogen.
Zugriff verweigert. Kein Zugriff. Für diesen Datensatz fehlen die Rechte. Für diese Seite fehlen die Rechte.
Ihre Sitzung ist abgelaufen. Ihre Anmeldung ist abgelaufen. Bitte neu anmelden. Bitte melden Sie sich erneut an.
Der Dienst ist vorübergehend nicht erreichbar, bitte später versuchen. Das Portal ist derzeit nicht erreichbar. Die Seite ist derzeit nicht verfügbar.
Erreur 404 : page introuvable. Erreur 410 : fiche supprimée. Erreur 404 : ressource inexistante.
Accès refusé : autorisation manquante pour cette fiche. Accès refusé : droits insuffisants pour cette page.
Votre session a expiré, reconnectez-vous. Votre session a expiré, veuillez vous identifier.
Service momentanément indisponible, réessayez plus tard. Portail momentanément indisponible.
Error 404: no se ha encontrado la página. Error 404: no se encuentra la ficha. No existe la página.
Acceso denegado a esta página. Acceso denegado a esta ficha. No tiene permiso.
Su sesión ha caducado, vuelva a entrar. Su sesión ha expirado, identifíquese de nuevo.
Portal en mantenimiento, vuelva más tarde. Servicio en mantenimiento, inténtelo mañana.
"""

_SCRIPT = """
Please enable JavaScript to view this page. Please allow scripts and cookies in your browser. Please activate JavaScript before you continue. Please turn on scripts to view this page.
You need to enable JavaScript to run this application. You need to allow scripts in your browser to see the supplier list.
This site requires cookies and JavaScript. This app requires active scripts. This portal requires cookies.
JavaScript is disabled. JavaScript is turned off. Scripting is blocked. The page cannot be shown. The form will not work without it. The supplier portal will not work without it.
Check your browser settings. Change the settings and reload.
Your browser is not supported. Your browser is too old. Your browser is out of date. Use a recent version to go on.
Checking your browser before opening the site. Verifying your browser before opening the portal. This takes a few seconds; scripts must be on. This takes a few seconds; cookies must be on. Reload when done.
Loading... Loading, please wait. If nothing happens, check that scripts are allowed. If nothing happens, turn off your script blocker.
noscript: content is rendered by the browser. No-script notice: nothing to show without a script engine.
Bitte aktivieren Sie JavaScript, um diese Seite zu sehen. Bitte erlauben Sie Skripte, um diese Akte zu sehen. Java Script
Diese Anwendung läuft nur mit JavaScript. Diese Seite läuft nur mit eingeschalteten Skripten und Cookies.
Ihr Browser wird nicht unterstützt. Ihr Browser ist veraltet.
Veuillez activer JavaScript pour afficher cette page. Veuillez autoriser les scripts pour afficher cette fiche. Ce portail a besoin des scripts et des cookies. Votre navigateur n'est pas compatible. Votre navigateur est trop ancien.
Active JavaScript para ver esta página. Habilite los scripts para ver esta ficha. Permita los scripts. El portal necesita que los scripts y cookies estén permitidos. Su navegador no es compatible. Su navegador es demasiado antiguo.
"""

_MENTION = """
Name tax_id email phone address city country category company source status version contact_email trust score golden record
Rule 6 flags values such as N/A, TBD or {{gap}} in name; 8 entities were hit.
Printed form 12: Name {{gap}} is for handwriting, and the scan was readable.
Le message « session expirée » apparaissait toutes les 5 minutes, c'est corrigé.
Mapping note: {{gap}}.name goes to name, {{gap}}.vat goes to tax_id, and {{gap}} is no longer read.
The mail template used {{gap}} as its only gap; the merge step fills it.
Das Feld {{gap}} in der Vorlage wird jetzt aus dem Stammsatz gefüllt.
Release note: the portal needs JavaScript from version 6 on, and stewards have been told.
During the review we removed lorem ipsum from 3 supplier descriptions that a web form had left behind.
A steward reported a 404 Not Found when opening the page; the link had a trailing blank and works again.
Gateway timeouts (504) delayed the load by 5 minutes, no rows were lost.
El error 500 del portal se debía a una carga; ya no ocurre.
The page said "Access denied" for 3 minutes because she had lost the steward role; rights are back.
The description was a sample text for 3 weeks until someone wrote a real one.
The {{gap}} in column name is the text "{{gap}}", sent by a source for 3 rows.
Dear Ann, your contact address is known; please tell us by May if it has changed. Thank you for registering as a supplier. Your tax number was accepted on May 3. Reference 3 stays valid for all mail from us. Kind regards, supplier desk in town
Guten Tag Ann, Ihr Zeichen lautet 3. Die Anmeldung von uns ist eingegangen, Steuernummer 3, Datum 3. Bitte bestätigen Sie die Adresse bis zum 3. Mit freundlichen Grüßen, Einkauf
Bonjour Ann, votre référence est 3. L'inscription de la société est enregistrée sous le numéro 3 depuis le 3. Merci de confirmer l'adresse avant le 3. Cordialement, service achats de la ville
Hola, Ann: su referencia es 3. El alta de la empresa consta con el número fiscal 3 desde el 3. Confirme la dirección antes del 3. Un saludo, compras de la ciudad
Home. Suppliers. Queue. Help. Sign in. Register. Contact. Back to overview. Skip to main content. Menü Suche Hilfe. Accueil Fournisseurs. Master data office. Supplier portal
Supplier profile: a name. Call note. Minutes of a town. Steward log of a day. Data-quality ticket 3. Review of a record. Glossary entry: source. Re: duplicate of a name
In field lists, version is written in brackets, as in {{gap}}, and {{gap}} marks a spelling kept on purpose.
"""

EXEMPLARS: tuple[tuple[str, str], ...] = tuple(
    (kind, line)
    for kind, block in (
        ("template", _TEMPLATE), ("filler", _FILLER), ("error", _ERROR), ("script", _SCRIPT), ("mention", _MENTION),
    )
    for line in block.strip().splitlines()
)
