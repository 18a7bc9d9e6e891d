"""Fixed word lists and rules, as the results depend on them."""

from __future__ import annotations

#: Function words that tell English.
ENGLISH = tuple(
    """
    a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during
    each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself
    no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them
    themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your
    yours yourself yourselves
    """.split()
)

#: Function words that tell French.
FRENCH = tuple(
    """
    alors au aucuns aussi autre avant avec avoir bon car ce cela ces ceux chaque ci comme comment dans de des du dedans dehors depuis devrait doit donc
    dos droite elle elles en encore essai est et eu fait faites fois font hors ici il ils je juste la le les leur là ma maintenant mais mes mine moins mon
    mot même ni nommés notre nous nouveaux ou où par parce parole pas personnes peut peu pièce plupart pour pourquoi quand que quel quelle quelles quels
    qui sa sans ses seulement si sien son sont sous soyez sujet sur ta tandis tellement tels tes ton tous tout trop très tu voient vont votre vous vu ça
    étaient état étions été être
    """.split()
)

#: Function words that tell German.
GERMAN = tuple(
    """
    aber als am an auch auf aus bei bin bis bist da dadurch daher darum das daß dass dein deine dem den der des dessen deshalb die dies dieser dieses doch
    dort du durch ein eine einem einen einer eines er es euer eure für hatte hatten hattest hattet hier hinter ich ihr ihre im in ist ja jede jedem jeden
    jeder jedes jener jenes jetzt kann kannst können könnt machen mein meine mit muß musst müssen müßt nach nachdem nein nicht nun oder seid sein seine
    sich sie sind soll sollen sollst sollt sonst soweit sowie und unser unsere unter vom von vor wann warum was weiter weitere wenn wer werde werden
    werdet weshalb wie wieder wieso wir wird wirst wo woher wohin zu zum zur über
    """.split()
)

#: Words that topic models leave out.
MODEL = tuple(
    """
    a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing
    down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most
    my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them
    themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your
    yours yourself yourselves article articles chapter figure figures journal page pages part plate plates proceedings review reviews section society vol
    volume
    """.split()
)

#: Months, numbers and journal words that topic models leave out too.
DOMAIN = tuple(
    """
    apr april aug august dec december feb february jan january july june mar march may nov november oct october sept september one two three four five six
    seven eight nine ten called day days fig fol good great large man men name names note notes page paper said says seen small time times used well known
    work year years
    """.split()
)

#: Words that title terms leave out.
TITLE = tuple(
    """
    a an and are as at be been being by for from had has have he her his in into is it its of on or our she that the their them these this those to was
    were which with without within about after before between during under over through upon some new old present part parts no notes note notice notices
    remarks remark observations observation account accounts report reports contribution contributions memorandum lecture paper papers journal article
    articles translation translated extract extracts appendix letter letters miscellaneous review reviews chapter chapters volume vol series royal asiatic
    society china chinese
    """.split()
)

#: Needles of a non-article, in order.
NON_ARTICLE = ('misc', 'proceedings', 'review', 'reviews', 'recent books', 'literary notes', 'notes and queries', 'queries', 'appendix', 'list')

#: File-name needles and the text type they stand for; the first hit counts.
TEXT_TYPES = (
    (('reviews_of_recent_books', 'review_of_recent_books', 'book_review', 'reviews', 'review'), 'book_review_or_review_section'),
    (('index',), 'index'),
    (('proceedings',), 'proceedings'),
    (('minutes',), 'minutes'),
    (('bibliography',), 'bibliography'),
    (('contents', 'table_of_contents', 'front_matter', 'preface', 'title_page'), 'front_matter'),
    (('appendix',), 'appendix'),
    (('advertisement', 'advertisements', 'ads'), 'advertisement'),
)

#: File-name needles of an uncertain type.
UNCERTAIN = ('misc', 'notes_and_queries', 'notes and queries', 'literary_notes', 'literary notes')
