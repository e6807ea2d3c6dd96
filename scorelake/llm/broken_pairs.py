"""Problem 5: prompts and responses that don't fit: empty, copy, refusal, language, truncated."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 3
#: A copy holds so much of the prompt, in order, and so little else (the words of a wrapping).
COVERED, WRAPPING = 0.95, 4
#: Words between two slots of a refusal template.
GAP = 4
#: Evidence for another language by letters: least words, and by how much a word on average must fit it better, in nats.
LETTER_WORDS, LETTER_MARGIN = 4, 1.0

# Templates of refusals by language: slots in order, up to GAP words apart, within a sentence. A slot is a list of words, or
# beginnings of words where it ends in *; a capital letter stands for a class of its own below.
_REFUSALS = {
    "en": """
        S N A | S A N | S N V | S N W | N A S V | N Q A | Q N A X | N T S A | N A T | S K | K S | K T X
        L S A | L M R | L R | N G | S N G | N let|allow*|permit*|enable* S | N enough|sufficient information|data|detail*|context | N Q from|here | N way | S N know* idea | N B V | S leav* alone | O S N | impossible M V | impossible to V
    """,
    "de": "ich|mir|wir nicht*|kein*|leider kann|darf|möchte|will|werde|könn*|dürf*|möglich | kann|darf|möchte|will|werde|könn*|dürf* ich|wir nicht*|kein*|leider | ich|wir kann|darf|möchte|will|werde|könn* nicht*|kein* | lehne* ab | übersteigt|überschreitet|außerhalb meine* | weiger*|verweiger*|ablehn* | ohne zugriff*|berechtigung*|zugang* | kein*|fehl* zugriff*|berechtigung*|zugang* | leider nicht*|kein* | nicht* möglich|beantwort*|erlaubt|gestattet",
    "fr": "je ne|n peux|puis|suis|saurais|veux|pourrai* | refus* | ne peux|puis|saurais|pouvons|pourrai* | impossible de|d | dépass* autoris*|permis|capacit*|limit* | sans|pas|aucun accès|autorisation | désolé* ne|pas|impossible | préfère ne|pas | impossibilité de|d | m interdit|impossible",
    "es": "no puedo|podemos|podría|puede|debo|quiero|tengo|dispongo|sé|estoy|es|voy respond*|ayud*|contest*|escrib*|hac*|gener*|permi*|acceso|autoriz*|posible|dar|ofrec*|proporcion*|cómo|en|a | sin acceso|permiso | me niego|rehúso | rechaz* | prefiero|preferiría no | lamento|siento no|pero | imposible respond*|contest*|saber",
    "it": "non posso|possiamo|potrei|sono|riesco|voglio|intendo|ho|è | mi rifiuto | rifiuto|declino | dispiace|spiacente non|ma | senza accesso | preferisco non",
    "pt": "não posso|podemos|consigo|estou|sou|tenho|quero|vou|é | me recus* | recus*|declin* | sem acesso | lamento|desculp* não|mas | prefiro não",
    "nl": "kan|mag|wil|kunnen|mogen|zal ik|we|wij|u|je niet|geen | ik|wij|we kan|mag|wil|kunnen|zal niet|geen | niet helpen|beantwoorden|mogelijk|toegestaan | weiger* | zonder|geen toegang | helaas niet|geen|kan | spijt|sorry niet",
    "pl": "nie mogę|możemy|jestem|potrafię|umiem|wolno|mam|da|chcę | odmawiam|odmawiamy | bez dostępu | niestety nie | przykro nie",
    "sv": "kan|får|vill|tänker|kommer jag|vi inte|ej|tyvärr | jag|vi kan|får|vill|tänker inte|ej | tyvärr inte|kan | vägrar|avböjer | utan åtkomst|tillgång",
    "da": "kan|må|vil|får|tør jeg|vi ikke|desværre|dessverre | jeg|vi kan|må|vil|får ikke | desværre|dessverre ikke|kan | nægter|nekter|afviser|avslår | uden|uten adgang|tilgang",
    "fi": "en|emme voi|pysty|saa|osaa|halua|pystyisi|voisi | valitettavasti en|emme|ei | ei ole|voida mahdollista|sallittua|vastata | kieltäydyn|kieltäydymme",
    "tr": "*amam|*emem|*amıyorum|*emiyorum|*amayız|*emeyiz | üzgünüm|maalesef|malesef | reddediyor* | mümkün değil | izn*|yetki* yok",
    "cs": "nemohu|nemůžu|nemůžeme|nesmím|nedokážu|nejsem|neumím | odmítám | bohužel ne*|není | nemožn* ",
    "hu": "nem tudok|tudom|tudunk|áll|lehet|szabad|válaszolhat*|segíthet*|adhat* | sajnos|sajnálom nem | megtagad*|elutasít*",
    "ro": "nu pot|putem|sunt|am|îmi|este | refuz | îmi pare | din păcate nu",
    "id": "tidak|tak bisa|dapat|boleh|mampu|diizinkan|punya | maaf tidak|saya | menolak",
    "ru": "не могу|можем|смогу|имею|вправе|буду|знаю|в | отказываюсь|отказываемся | невозможно|нельзя | к сожалению не|нет | без|нет доступа",
    "uk": "не можу|можемо|зможу|маю|буду | відмовляюся | на жаль | неможливо",
}
#: Signs of a refusal in scripts without spaces between words, or without the alphabets above.
_SIGNS = re.compile("できません|出来ません|できかね|お答えでき|お断り|わかりません|無法|无法|不能回答|不能提供|不能幫|不能帮|不便|拒绝|拒絕|抱歉|할 수 없|수 없습니다|죄송|거절|لا أستطيع|لا يمكنني|أعتذر|אינני יכול|לא יכול|लेने में असमर्थ|नहीं कर सकत|नहीं दे सकत|δεν μπορώ|ไม่สามารถ")
_CLASSES = {
    "S": "i|we|me|us|my|our|myself|assistant|model",
    "N": "not|no|never|nothing|none|neither|cannot|unable|hardly|n't|without|lack*",
    "A": "can|cannot|could|will|would|able|unable|may|might|allowed|permitted|authori*|willing|going|prepared|ready|comfortable|capable|supposed|qualified|meant|possible|free|position|happy|touch|inclined",
    "V": "answer*|help*|assist*|provid*|produc*|writ*|giv*|given|generat*|tell|told|respond*|reply|comply|creat*|build|discuss*|offer*|complet*|fulfil*|support*|share|shared|do|done|say|said|know*|see|reach*|work*|go|translat*|handl*|take|touch|proceed|continu*|resolv*|solv*|satisf*|deliver*|formulat*|mak*|determin*|meet|met|suppl*|select*|access|retriev*|look*",
    "W": "rather|prefer*|want|wish|intend|dare|think|believe|feel",
    "K": "declin*|refus*|abstain*|rather|prefer*|pass|refrain*|apologi*|regret*",
    "Q": "query|answer|response|statement|sql|information|result",
    "X": "not|n't|answer*|help*|provid*|produc*|writ*|given|generat*|come|one|that|this|do|leave|stay|say|skip|avoid",
    "T": "that|this|it|something|there|anything|what|request|question|task|topic|one|these",
    "L": "beyond|outside|exceed*|past|against|violat*|breach*|contrary|conflict*|above|prohibit*|forbid*|prevent*|bars|stops",
    "M": "what|my|the|our|for|me|of",
    "R": "guideline*|polic*|rule*|permit*|allow*|scope|capabilit*|abilit*|limit*|remit|reach|boundar*|competen*|authori*|purpose|instruct*|me|training|principle*",
    "G": "access|permission*|clearance|authori*|ability|right|rights|means|connection|visibility|knowledge",
    "B": "be|possible|way|answer*|can|could",
    "O": "sorry|afraid|unfortunately|regret*|apolog*|alas|sadly",
}

# Words that are frequent in a language. A word of several languages counts for each by its share.
WORDS = {
    "en": "the of and to is are was were for with that this these those it its be been by from at as not no or if but how many what which whose who there here you your we i me my us they have has had do does did can could should would will don't won't than then so all each every show list find give tell return report display count need between only also before after more most other any same a an in on so without both over under into must may might because therefore hence while about out up down off again now just even still very too few first second whose answer query statement rows table column",
    "de": "der die das den dem des ein eine einer einem einen und oder ist sind war nicht kein keine für mit von aus auf bei zu zum zur im wie viele haben hat als dass wenn wird werden auch über unter nach vor nur sich es ich wir dieser diese dieses nenne sofern stammen liegt höchstens zuständig bitte leider ohne deren dafür deshalb jede tabelle zeilen abfrage spalte antworten",
    "fr": "le la les l' un une des du de et ou est sont ne pas pour avec dans sur par que qui quand ce cette ces il elle on nous vous je à au aux en se sa son ses leur combien donne dont plus moins d'abord puis une seule suffit à savoir sous sans été ont déjà ici table lignes requête colonne réponses",
    "es": "el la los las un una de del y o es son no para con en por que se su sus al lo como más cuántos cuando muestra tienen igual mayor pertenecen responsable hay esta este esa ese antes después primero fue han sin qué si ya nadie cada queda falta informe basta tabla consulta filas número registros columna respuestas",
    "it": "il lo la i gli le un una di del della dei delle e è sono non per con nel nella che si al alla come più ogni qui prima poi cui da su questo questa ha stata rimaste senza basta sola cioè perciò manca tabella righe numero colonna risposte",
    "pt": "o a os as um uma de do da dos das e é são não para com em no na nos nas que se ao à por mais cada só foi ficaram sem mostramos depois primeiro cujo uma passa fica chega devolve linhas isso tabela número registos coluna respostas consulta",
    "nl": "de het een en of is zijn was niet geen voor met van uit op bij te in als dat die dit deze wordt worden ook naar alleen wij we eerst daarna blijft bleven hier waarvan daarom genoeg kreeg elke levert alle ligt over zonder tabel rijen vraag kolom antwoorden",
    "pl": "i w z na do nie się jest są że to dla po od przez który która które oraz ale jak tak bez więc zostało łączymy potem zostaje nie ma jej dlatego każdej wystarczy zapytanie zwraca których jedna tylko najpierw później tabeli wiersze kolumnę odpowiedzi",
}
_BY_WORD: dict[str, list[tuple[str, float]]] = {}
for _lang, _list in WORDS.items():
    for _w in sorted(set(_list.split())):
        _BY_WORD.setdefault(_w, []).append((_lang, 1.0))
_BY_WORD = {w: [(lang, 1.0 / len(ls)) for lang, _ in ls] for w, ls in _BY_WORD.items()}

# Prose by language, of which profiles of letters are made.
_PROSE = {
    "en": "all human beings are born free and equal in dignity and rights they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood this query returns every row of the table that matches the condition and then sorts the result by the second column we only need to count the records for each group here is what was asked please check whether the values are right because the first answer was not complete",
    "de": "alle menschen sind frei und gleich an würde und rechten geboren sie sind mit vernunft und gewissen begabt und sollen einander im geist der brüderlichkeit begegnen diese abfrage gibt jede zeile der tabelle zurück welche die bedingung erfüllt und sortiert danach das ergebnis nach der zweiten spalte wir müssen nur die einträge für jede gruppe zählen hier ist das was gefragt wurde bitte prüfen ob die werte richtig sind weil die erste antwort nicht vollständig war",
    "fr": "tous les êtres humains naissent libres et égaux en dignité et en droits ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité cette requête renvoie chaque ligne de la table qui remplit la condition puis trie le résultat selon la deuxième colonne il faut seulement compter les enregistrements de chaque groupe voici ce qui était demandé veuillez vérifier si les valeurs sont justes car la première réponse était incomplète",
    "es": "todos los seres humanos nacen libres e iguales en dignidad y derechos y dotados como están de razón y conciencia deben comportarse fraternalmente los unos con los otros esta consulta devuelve cada fila de la tabla que cumple la condición y luego ordena el resultado por la segunda columna solo hay que contar los registros de cada grupo aquí está lo que se pidió compruebe si los valores son correctos porque la primera respuesta no estaba completa",
    "it": "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza questa interrogazione restituisce ogni riga della tabella che soddisfa la condizione e poi ordina il risultato secondo la seconda colonna bisogna solo contare le registrazioni di ciascun gruppo ecco quello che era stato chiesto controllate se i valori sono giusti perché la prima risposta non era completa",
    "pt": "todos os seres humanos nascem livres e iguais em dignidade e em direitos dotados de razão e de consciência devem agir uns para com os outros em espírito de fraternidade esta consulta devolve cada linha da tabela que cumpre a condição e depois ordena o resultado pela segunda coluna só é preciso contar os registos de cada grupo aqui está o que foi pedido verifique se os valores estão certos porque a primeira resposta não estava completa",
    "nl": "alle mensen worden vrij en gelijk in waardigheid en rechten geboren zij zijn begiftigd met verstand en geweten en behoren zich jegens elkander in een geest van broederschap te gedragen deze vraag geeft elke rij van de tabel terug die aan de voorwaarde voldoet en sorteert daarna het resultaat op de tweede kolom we hoeven alleen de gegevens van iedere groep te tellen hier staat wat er gevraagd werd kijk even of de waarden goed zijn want het eerste antwoord was niet volledig",
    "pl": "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa to zapytanie zwraca każdy wiersz tabeli który spełnia warunek a potem sortuje wynik według drugiej kolumny trzeba tylko policzyć wpisy w każdej grupie oto o co pytano proszę sprawdzić czy wartości są poprawne ponieważ pierwsza odpowiedź nie była pełna",
    "sv": "alla människor är födda fria och lika i värde och rättigheter de har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap den här frågan ger tillbaka varje rad i tabellen som uppfyller villkoret och sorterar sedan resultatet efter den andra kolumnen vi behöver bara räkna posterna för varje grupp här är det som efterfrågades kontrollera gärna om värdena stämmer eftersom det första svaret inte var fullständigt",
    "da": "alle mennesker er født frie og lige i værdighed og rettigheder de er udstyret med fornuft og samvittighed og de bør handle mod hverandre i en broderskabets ånd denne forespørgsel giver hver række i tabellen som opfylder betingelsen og sorterer derefter resultatet efter den anden kolonne vi skal kun tælle posterne for hver gruppe her er det der blev spurgt om kontroller gerne om værdierne er rigtige fordi det første svar ikke var fuldstændigt",
    "fi": "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä tämä kysely palauttaa jokaisen taulun rivin joka täyttää ehdon ja järjestää sitten tuloksen toisen sarakkeen mukaan meidän tarvitsee vain laskea kunkin ryhmän tietueet tässä on se mitä pyydettiin tarkista ovatko arvot oikein koska ensimmäinen vastaus ei ollut täydellinen",
    "tr": "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler bu sorgu koşulu sağlayan tablodaki her satırı döndürür ve sonra sonucu ikinci sütuna göre sıralar yalnızca her grup için kayıtları saymamız gerekir işte istenen budur lütfen değerlerin doğru olup olmadığını kontrol edin çünkü ilk yanıt tam değildi",
    "cs": "všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství tento dotaz vrací každý řádek tabulky který splňuje podmínku a potom řadí výsledek podle druhého sloupce stačí jen spočítat záznamy v každé skupině zde je to na co se ptali prosím zkontrolujte zda jsou hodnoty správné protože první odpověď nebyla úplná",
    "hu": "minden emberi lény szabadon születik és egyenlő méltósága és joga van az emberek ésszel és lelkiismerettel bírván egymással szemben testvéri szellemben kell hogy viseltessenek ez a lekérdezés visszaadja a tábla minden sorát amely megfelel a feltételnek majd rendezi az eredményt a második oszlop szerint csak meg kell számolni az egyes csoportok rekordjait itt van amit kértek kérem ellenőrizze hogy az értékek helyesek mert az első válasz nem volt teljes",
    "ro": "toate ființele umane se nasc libere și egale în demnitate și în drepturi ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității această interogare întoarce fiecare rând al tabelului care îndeplinește condiția și apoi ordonează rezultatul după a doua coloană trebuie doar să numărăm înregistrările din fiecare grup iată ce s-a cerut vă rog verificați dacă valorile sunt corecte pentru că primul răspuns nu a fost complet",
    "id": "semua orang dilahirkan merdeka dan mempunyai martabat dan hak yang sama mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan kueri ini mengembalikan setiap baris tabel yang memenuhi syarat lalu mengurutkan hasilnya menurut kolom kedua kita hanya perlu menghitung catatan untuk setiap kelompok inilah yang ditanyakan silakan periksa apakah nilainya benar karena jawaban pertama belum lengkap",
}


def _grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)] + [w]


def _profiles() -> tuple[list[str], dict[str, np.ndarray], np.ndarray]:
    """Log-probabilities by language of letter pairs, letter triples and whole words, and that of one never seen."""
    names = list(_PROSE)
    counts: dict[str, np.ndarray] = {}
    for k, text in enumerate(_PROSE.values()):
        for word in text.split():
            for g in _grams(word):
                counts.setdefault(g, np.zeros(len(names)))[k] += 1
    total = np.sum(list(counts.values()), axis=0) + 0.2 * len(counts)
    return names, {g: np.log((c + 0.2) / total) for g, c in counts.items()}, np.log(0.2 / total)


_NAMES, _PROFILE, _UNSEEN = _profiles()


def fit_by_letters(words: list[str]) -> np.ndarray:
    """How well each language of the profiles fits the words: the mean, over the words, of their summed log-probabilities."""
    total = np.zeros(len(_NAMES))
    for w in words:
        grams = _grams(w)
        total += np.sum([_PROFILE.get(g, _UNSEEN) for g in grams], axis=0) * 4 / len(grams)
    return total / max(1, len(words))


_FENCE = re.compile(r"(?:```|~~~)[A-Za-z0-9_+-]*")
_ALNUM = re.compile(r"[^\W_]")
_TOKEN = re.compile(r"[^\W_]+")
_INSIDE = re.compile(r"(?<=\w)[^\w\s](?=\w)")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_SELECT = re.compile(r"\bselect\b", re.I)
_QUOTED = re.compile(r"'[^']*'|\"[^\"]*\"|`[^`]*`")
_MORE_SQL = re.compile(
    r"""\s*(?:
      (?:and|or|where|having|on)\s*(?:[\w."`(\[]+\s*(?:$|[=<>!*/+,)-]|(?:like|in|not|between|is)\b|\()|$|not\b|exists\b)
    | (?:from|join|inner\s+join|left\s+join|cross\s+join|select|union|intersect|except)\b
    | (?:order|group)\s*(?:by\b|$) | limit\s*(?:\d|$) | offset\s*\d | (?:asc|desc)\b
    | (?:in|not\s+in)\s*(?:\(|$) | (?:like|between|is)\s+['"\d(n] | ['"`(),=<>!*;] | \d+(?:\.\d+)?\s*(?:$|[,;)]|and\b)
    | [\w.]+\s*(?:[=<>!,]|like\b|in\s*\() | [\w.]+\s*;?\s*$
    )""",
    re.I | re.X,
)
_CALLS_FOR_MORE = re.compile(
    r"(?:\b(?:select|distinct|from|where|and|or|not|in|like|between|order|group|by|limit|offset|having|on|join|inner|left|right|outer|cross|union|all|intersect|except|is|as|case|when|then|else|exists)|[=<>!+\-/,(])$",
    re.I,
)
_BARE_END = re.compile(r"\b(?:where|and|or|having|on)\s+\(?\s*[A-Za-z_][\w.]*$", re.I)
_FROM = re.compile(r"\bfrom\b", re.I)
#: Statements that aren't queries: whole as they are.
_OTHER_SQL = re.compile(r"^[ \t]*(?:insert\s+into\s+\S+.*(?:values\s*\(.*\)|select\b)|update\s+\S+\s+set\s+\S|delete\s+from\s+\S)", re.I | re.M | re.S)
#: What stands before a "select" that is an ordinary verb.
_NOT_SQL = re.compile(r"(?:\b(?:can|could|will|would|must|may|unable to|able to|not|cannot)|n['’]t)[ \t]+(?:[a-z]+[ \t]+)?$", re.I)


def tokens(text: str) -> list[str]:
    """Words in lower case; punctuation inside a word or number doesn't part it."""
    return _TOKEN.findall(_INSIDE.sub("", text.lower()))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (one addition per token)."""
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for t in b:
        hit = row & where.get(t, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _shingles(t: list[str]) -> set:
    return set(zip(*(t[i:] for i in range(SHINGLE)))) if len(t) >= SHINGLE else {tuple(t)}


def is_copy(answer: list[str], prompt: list[str]) -> bool:
    """True if the answer's tokens are the prompt's, once or repeated, but for a few words of wrapping.

    Shingle containment in both directions comes first; the longest common subsequence decides.
    """
    if not prompt or len(answer) < COVERED * len(prompt):
        return False
    own, theirs = _shingles(answer), _shingles(prompt)
    common = len(own & theirs)
    if common < 0.9 * len(theirs) or common < 0.6 * len(own):
        return False
    times = max(1, round(len(answer) / len(prompt)))
    whole = prompt * times
    shared = common_subsequence(answer, whole)
    return shared >= COVERED * len(whole) and len(answer) - shared <= WRAPPING * times


def _said(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower().replace("’", "'"))]


def _slot(spec: str) -> re.Pattern:
    """A pattern over whole words."""
    words = "|".join(_CLASSES.get(w, w) for w in spec.split("|")).split("|")
    return re.compile("|".join(re.escape(w).replace(r"\*", r"[^ ]*") for w in words))


def _template(slots: list[str]) -> re.Pattern:
    """Slots in order with up to GAP words between them, over words joined and surrounded by single spaces."""
    return re.compile(f" (?:[^ ]+ ){{0,{GAP}}}?".join(f"(?:{_slot(x).pattern})" for x in slots).join((" ", " ")))


_TEMPLATES = {lang: [_template(t.split()) for t in text.split(" | ") if t.strip()] for lang, text in ((k, " ".join(v.replace("\n", " | ").split())) for k, v in _REFUSALS.items())}
_SENTENCE = re.compile(r"[.!?;:。！？…\n]+|,\s+(?:but|so|and|here|aber|mais|pero|ma|mas|maar|ale|men|mutta|ama|но)\b")
_SHORT_NOT = re.compile(r"n't\b")
_PIECE = re.compile(r"(?<![^\W\d_])n't\b|[^\W\d_]+|\d+")


def is_refusal(text: str) -> bool:
    """True if a sentence of the text is aligned with a template: somebody who can't, may not or won't."""
    if not text.isascii() and _SIGNS.search(text):
        return True
    for sentence in _SENTENCE.split(_SHORT_NOT.sub(" n't", text.lower().replace("’", "'").replace("can't", "cannot").replace("won't", "will n't").replace("ain't", "is n't"))):
        line = f" {' '.join(_PIECE.findall(sentence))} "
        if line.strip() and any(t.search(line) for own in _TEMPLATES.values() for t in own):
            return True
    return False


def language(text: str) -> tuple[str | None, dict[str, float]]:
    """The language of prose by script and function words, and each language's score; None if it can't be told."""
    score: dict[str, float] = {}
    han = kana = cyrillic = other = letters = 0
    if not text.isascii():
        for ch in text:
            if ch.isalpha():
                letters += 1
                o = ord(ch)
                if 0x3040 <= o <= 0x30FF:
                    kana += 1
                elif 0x3400 <= o <= 0x9FFF:
                    han += 1
                elif 0x400 <= o <= 0x52F:
                    cyrillic += 1
                elif 0x370 <= o <= 0x3FF or 0x590 <= o <= 0x1FFF or 0xAC00 <= o <= 0xD7AF:
                    other += 1
    if kana >= 2:
        return "ja", {"ja": kana}
    if han >= 2:
        return "zh", {"zh": han}
    if cyrillic >= 3:
        return "ru", {"ru": cyrillic}
    if other >= 3:
        return "xx", {"xx": other}
    for w in _said(text):
        for lang, share in _BY_WORD.get(w, ()):
            score[lang] = score.get(lang, 0.0) + share
        if "'" in w:  # elided article: l'essai
            for lang, share in _BY_WORD.get(w.split("'")[0] + "'", ()):
                score[lang] = score.get(lang, 0.0) + share
    best = max(score, key=lambda k: (score[k], k), default=None)
    return best, score


def other_language(prose: str, asked: str) -> bool:
    """True if prose is clearly in another language than ``asked``, a text in the language expected.

    Function words and scripts come first. Where they tell no language, profiles of letters are held
    against the words of the prose that ``asked`` doesn't hold and that no other sign marks as a name.
    """
    mine, score = language(prose)
    theirs, _ = language(asked)
    if theirs is None:
        return False
    if mine is not None and mine != theirs and score[mine] >= 1 and score[mine] >= score.get(theirs, 0.0) + 1:
        return True
    if theirs not in _NAMES or mine not in (*_NAMES, None) or score.get(theirs, 0.0) >= 1:
        return False
    known = set(_said(asked))
    words = [w for w in re.findall(r"(?<![\w.])[^\W\d_]+(?![\w.(])", prose) if w.lower() not in known and not w[1:].isupper()]
    if len(words) < LETTER_WORDS:
        return False
    fit = fit_by_letters([w.lower() for w in words])
    return fit.max() - fit[_NAMES.index(theirs)] >= LETTER_MARGIN


def statements(text: str) -> tuple[list[str], str]:
    """The SQL statements of a text without fences, and the prose around them.

    A statement runs from SELECT to a semicolon outside quotes, or to a line that doesn't go on with SQL.
    """
    found, prose, at, begin = [], [], 0, 0
    while m := _SELECT.search(text, begin):
        if _NOT_SQL.search(text, max(at, m.start() - 40), m.start()):
            begin = m.end()
            continue
        prose.append(text[at : m.start()])
        end, stop = len(text), None
        quote, i = "", m.start()
        while i < len(text):
            ch = text[i]
            if quote:
                if ch == quote:
                    quote = ""
                elif ch == "\n" and (rest := text[i + 1 :].split("\n", 1)[0]).strip() and not _MORE_SQL.match(rest) and quote not in rest:
                    end = stop = i
                    break
            elif ch in "'\"`":
                quote = ch
            elif ch == ";":
                end, stop = i, i + 1
                break
            elif ch == "\n":
                rest = text[i + 1 :].split("\n", 1)[0]
                if rest.strip() and not _MORE_SQL.match(rest):
                    end = stop = i
                    break
            elif ch == "-" and text.startswith("--", i):
                end = stop = i
                break
            i += 1
        found.append(text[m.start() : end])
        at = begin = stop if stop is not None else len(text)
    prose.append(text[at:])
    return found, "\n".join(p for p in prose if p.strip())


def breaks_off(statement: str) -> bool:
    """True for an open quote or parenthesis, no FROM, or an end, dots apart, that calls for more."""
    bare = _QUOTED.sub("0", statement)
    if "'" in bare or '"' in bare or "`" in bare or bare.count("(") > bare.count(")") or not _FROM.search(bare):
        return True
    end = bare.rstrip(" \t\r\n .;…")
    return bool(_CALLS_FOR_MORE.search(end) or _BARE_END.search(end))


def defect_of(response: str | None, utterance: str | None, message: str | None) -> str | None:
    """The first defect that fits, or None. A null prompt can't be copied, and gives no language to compare with."""
    if response is None:
        return "empty"
    text = _FENCE.sub("", response) if "```" in response or "~~~" in response else response
    if not _ALNUM.search(text):
        return "empty"
    found, prose = statements(text)
    stated = any(map(_FROM.search, found))  # the word SELECT alone may stand in prose
    # a prompt that reads like a statement may be copied by what looks like one
    own = None
    for prompt in (utterance, message):
        if prompt and (not stated or _SELECT.search(prompt)):
            own = own if own is not None else tokens(text)
            if is_copy(own, tokens(prompt)):
                return "copy"
    if not stated:
        if not text.rstrip(" \t\r\n*/`").endswith((":", "：")) and is_refusal(text):  # a colon announces a statement
            return "refusal"
    if not stated and (other := _OTHER_SQL.search(text)) and not _CALLS_FOR_MORE.search(text.rstrip(" \t\r\n .;…")):
        return "language" if utterance and other_language(text[: other.start()], utterance) else None
    if not found:
        if utterance and other_language(text, utterance):
            return "language"
        return "truncated"
    if prose and utterance and other_language(prose, utterance):
        return "language"
    if breaks_off(found[-1]):
        return "truncated"
    return None


def broken_pairs(
    responses: DataFrame, response_id: str, instance_id: str, response: str, loaded_at: str, prompts: DataFrame, prompt_id: str, utterance: str, message: str
) -> DataFrame:
    """response_id, defect: one row per defective response, with its first defect.

    A response delivered several times counts as its latest version. Responses without a prompt (null or unknown id) are
    judged by themselves. Null ids of responses are no case. Extra columns aren't read. Empty tables give none.

    Prompts are joined by their id, a join that splits hot prompts (adaptive skew join); the whole message goes to Python
    only where a response is long enough for a copy and holds no statement, or the message itself reads like one.
    """
    asked = prompts.select(F.col(prompt_id).alias("_p"), F.col(utterance).alias("utterance"), F.col(message).alias("message")).dropDuplicates(["_p"])
    own = responses.select(F.col(response_id).cast("bigint").alias("response_id"), F.col(instance_id).alias("_i"), F.col(response).alias("response"), F.col(loaded_at).cast("timestamp").alias("loaded_at")).where("response_id is not null")
    paired = own.join(asked, F.col("_i") == F.col("_p"), "left")
    stated = F.coalesce(F.col("response"), F.lit("")).rlike(r"(?is)\bselect\b.*\bfrom\b")
    as_long = F.length("response") >= 0.8 * F.length("message")  # a copy is about as long as what it copies
    message_ = F.when((~stated | F.col("message").rlike(r"(?i)\bselect\b")) & as_long, F.col("message"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            defects = [defect_of(*x) for x in zip(*(b.column(c).to_pylist() for c in ("response", "utterance", "message")))]
            yield pa.RecordBatch.from_arrays([b.column("response_id"), b.column("loaded_at"), pa.array(defects, pa.string())], names=["response_id", "loaded_at", "defect"])

    judged = paired.select("response_id", "loaded_at", "response", "utterance", message_.alias("message")).mapInArrow(run, "response_id bigint, loaded_at timestamp, defect string")
    latest = judged.groupBy("response_id").agg(F.max_by("defect", F.struct(F.col("loaded_at").isNotNull(), "loaded_at", "defect")).alias("defect"))
    return latest.where("defect is not null")
