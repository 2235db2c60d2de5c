import pytest

from cartolith.llm import residue as R

FIELD = ["Welcome to {{city}}!", "Only undefined left in stock", "Dear [object Object], thank you.", "Price: %(price)s per night", "«SEASON»", "Bienvenue chez #ITEM_LABEL# !",
         "Stand: &#123;&#123;page_title&#125;&#125;", "Written by &lt;%= order_total %&gt; on #author#", "i18n:userName", "Hello [Your phone], bye", "Only [insert price here] left", "%s", "null",
         "A fine day.\nOpening hours of msg.userName.label: see below.\nMore text.", "Von :company: am *|SLOT|*", "Welcome to ???!", "Noch __PRICE__ verfügbar", "Hello ${count}, {0} new"]
NOT_FIELD = ['Example: "{{ x }}" turns into "Anna".', "Write `%HEADER%` where the name should appear.", "The set {1, 2, 3} and the interval [0, 1] appear on page 6.", "Write to info [at] the address.",
             "She wrote [sic] in the margin and added note [12].", "Mail merge fields like [FIRST NAME] are explained in lesson 5.", "Undefined borders were drawn, and null results went into the appendix.",
             "The manual writes ${total} for a variable and {0} for the first argument.", "It is 50 % off at 9:15, see www.shop.example", "None of the ferries ran.", "Why the hill measures the lake is a question for None.", "Warning: db_fetch() expects parameter 1 to be array, null given in /srv/a/b.inc on line 3", "", "Le manuel cite « {{ titre }} » comme exemple de variable de gabarit."]
EMPTY = ["Tadazu valley\n\nThis session has timed out. Start over.", "Home | Search | Login\nHill path\nPage not found\nAll rights reserved", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
         "Ihr Browser wird geprüft ...", "Désolé, la page demandée est introuvable.", "DÃ©solÃ©, la page demandÃ©e est introuvable.", "Acceso denegado", "TODO: write intro\nYour text here.",
         "Please enable JavaScript to view this page.", "Error 404", "This portal will not run in this browser.", "Merci d’activer JavaScript pour afficher ce site.", "Fatal: uncaught QueryError in /srv/a/core.inc:8\n#0 /srv/a/run.inc(7): render()\n#1 {main}", "blah asdf foo bar"]
REAL = ["The bridge is closed for maintenance until spring; walkers take the lower path.", "Closed on Mondays.", "Access to the tower is denied to dogs.", "The harbour of Tova lies near the second gate.",
        "Blindtext war früher in Druckereien üblich, heißt es im Museum.", "Old mill\nSome features of this page work better with JavaScript switched on.\nThe mill grinds on Sundays.",
        "Error 404 is explained in chapter 5 of the guide.", "Home | Search | Login", ""]


def known(url, text):
    """Whether all of a text's body is known residue."""
    body = R.take_apart(url, text)[0]
    return 2 in body.values() and all(body.values())


@pytest.mark.parametrize("text", FIELD)
def test_fields(text):
    assert R.shows_field(text)


@pytest.mark.parametrize("text", NOT_FIELD)
def test_mentions(text):
    assert not R.shows_field(text)


@pytest.mark.parametrize("text", EMPTY)
def test_empty(text):
    assert known(None, text)


@pytest.mark.parametrize("text", REAL)
def test_real(text):
    assert not known("http://x.example/a", text)


SCHEMA = "doc_id bigint, host string, url string, text string, t string"


def test_table(spark):
    rows = [(i, None if i % 3 else "H.example", "https://h.example/a.html", t, "x") for i, t in enumerate([*FIELD, *EMPTY, *REAL, None, "  \n ", *EMPTY[:1]])]
    rows += [(900, None, "::bad url[", "Page not found", "x"), (901, "h", None, "word " * 200_000, "x"), (None, "h", None, "Page not found", "x")]
    got = [r["doc_id"] for r in R.residue(spark.createDataFrame(rows, SCHEMA)).collect()]
    n = len(FIELD) + len(EMPTY)
    assert sorted(got, key=repr) == sorted([*range(n), len(rows) - 4, 900, None], key=repr)
    assert R.residue(spark.createDataFrame([], SCHEMA)).count() == 0


def test_company(spark):
    odd = "Zorblax quux vermin flonk."  # a message of no known vocabulary
    rows = [(i, f"h{i % 3}.example", "https://x.example/p/q", f"Page not found. {odd}", "x") for i in range(6)]
    assert R.residue(spark.createDataFrame(rows, SCHEMA)).count() == 6
    real = [(100 + i, "r.example", "https://x.example/p", f"The lake froze early. Boats lay on the shore. Nobody came. {odd}", "x") for i in range(6)]
    assert R.residue(spark.createDataFrame(rows + real, SCHEMA)).count() == 0
    named = [(i, h, "https://x.example/zorblax", t, x) for i, h, _, t, x in rows]
    assert R.residue(spark.createDataFrame(named, SCHEMA)).count() == 0


def test_company_of_many(spark):
    odd = "Zorblax quux vermin. Flonk arve mit. Brelk toso nim. Quell dabo rin."  # more than two unknown sentences
    rows = [(i, f"h{i % 3}.example", f"https://x.example/p{'abcdef'[i]}{'uvwxyz'[i]}q", f"Page not found. {odd}", "x") for i in range(6)]
    assert R.residue(spark.createDataFrame(rows, SCHEMA)).count() == 6
    copies = [(i, h, u, f"Hill of Dabu\n\n{t}", x) for i, h, u, t, x in rows]  # one page on several hosts
    assert R.residue(spark.createDataFrame(copies, SCHEMA)).count() == 0
    real = [(i, h, u, "Closed on Mondays.", x) for i, h, u, _, x in rows]  # repeated as it is, yet real
    assert R.residue(spark.createDataFrame(real, SCHEMA)).count() == 0


@pytest.mark.parametrize("text", ["Download the manual: {{ file }}", "Welcome, {{ template.title }}", "${string}", "[[method]]", "Example rate: undefined per night",
                                  "Tower, example, 5 km; template; Price ${price}; interval", "The string is long, and the price ${price} too"])
def test_words_near_fields(text):
    assert R.shows_field(text)


@pytest.mark.parametrize("text", ["Use a name such as {{ title }} there.", "Im Handbuch steht {{ name }} als Beispiel für eine Variable der Vorlage.", "El manual usa ${total} como ejemplo de variable.",
                                  "The method ${a} runs first, then ${b} prints the object.", "The manual writes ${a} for a variable, ${b} for a string and {0} for the first argument."])
def test_spoken_about(text):
    assert not R.shows_field(text)


@pytest.mark.parametrize("text", ["Preis: NaN Euro", "Preis: undefined Euro", "Anteil NaN Prozent", "Showing undefined of 12 results", "Showing null of 12 results", "Escrito por Ana el null", "Total is NaN",
                                  "Hello None, your order has left.", "Escrito por None el lunes"])
def test_values(text):
    assert R.shows_field(text)


@pytest.mark.parametrize("text", ["Es war null Grad und null Uhr.", "The border is undefined.", "It is null and void.", "None of the ferries ran.", "A trip to None, by the lake.", "Ein null Fehler kommt vor."])
def test_no_values(text):
    assert not R.shows_field(text)


@pytest.mark.parametrize("text", ["{{ price | currency }}", "{{ user-name }}", "{{ 'cart.total' | translate }}", "{{#if order}}", "{% for x in items %}", "${user.getName()}", "<?php echo $title; ?>",
                                  "<%= @user.name %>", "{{ été }}", "Price {{ " + "long_name" * 9 + " }} a night", "{{ cond ? yes : no! }}", "&#123;&#123; a | b &#125;&#125;"])
def test_expressions(text):
    assert R.shows_field(text)


@pytest.mark.parametrize("text", ["{{ }}", "Costs $ {5, 6} and {a, b}", '<?xml version="1.0"?>', "Write `{{ price | currency }}` where the price should appear."])
def test_no_expressions(text):
    assert not R.shows_field(text)


COOKIES = "We use files of many kinds on this site and its partner sites to measure visits, remember your settings, keep you signed in, count the readers of each page, show maps in your language and improve our service with cookies"


def test_long_notices():
    for text in (f"{COOKIES}.\nPage not found.", f"{COOKIES}. Page not found.", f"Page not found. {COOKIES}"):
        assert len(text) > 200 and known(None, text)
    assert not known(None, f"{COOKIES}. Page not found. The mill grinds on Sundays.")
    assert not known(None, f"{COOKIES}. The mill grinds on Sundays.")


@pytest.mark.parametrize("text", ["Dear {{name}}, our method is simple.", "Welcome back {{user_name}}, see the example below.", "{% trans 'x' %}", "{{ user | upper }}", "Visit @@" + "place" * 30 + "@@ today", "[" + "Name" * 20 + "]"])
def test_fields_of_any_length(text):
    assert R.shows_field(text)


@pytest.mark.parametrize("text", ["Coming soon: our new 14 km circular walk over the ridge opens in June.", "Reject null hypothesis when p is below 0.05.", "Array[index] starts at 0.", "A null pointer ends it.",
                                  "Please contact the webmaster to connect the server to the database."])
def test_words_of_residue_in_content(text):
    assert not R.shows_field(text) and not known(None, text)


@pytest.mark.parametrize("text", ["502 Bad Gateway nginx", "HTTP/1.1 404 Not Found", "503 - Service Unavailable\nnginx/1.18", "Home | Search\n404: Not Found"])
def test_status_lines(text):
    assert known(None, text) or text.endswith("1.18")


def reasons(spark, rows):
    return {r["doc_id"]: r["reason"] for r in R.residue(spark.createDataFrame(rows, SCHEMA)).collect()}


def pages(n, body, first=0, titles=True):
    """n pages of one body on four hosts, each under its own title or address."""
    word = lambda i: "".join("bdfgklmnrt"[int(c)] + "aeiou"[int(c) // 2] for c in f"{i:03}")
    return [(first + i, f"h{i % 4}.example", f"https://h.example/{word(i)}", (f"Path of {word(i)}\n\n" if titles else "") + (body(i) if callable(body) else body), "x") for i in range(n)]


@pytest.mark.parametrize("body", ["Pagina niet gevonden", "Stranica ne postoji. Pokrenite ponovo.", "Sivua ei loydy.\nKoodi X9-77"])
def test_wording_of_no_vocabulary(spark, body):
    assert not known(None, body)
    got = reasons(spark, pages(12, body) + pages(8, lambda i: f"The mill number {i} grinds well in Bado{'xyz'[i % 3]}.", 100))
    assert got == {i: "repeated" for i in range(12)}
    # beside content it says nothing of a page
    real = pages(12, lambda i: body + f"\nIn {'abcdefghijkl'[i]}ova they tell of the {'mnopqrstuvwx'[i]}ull in the {'abcdefghijkl'[i]}ond.", 100)
    assert not set(reasons(spark, pages(12, body) + real)) & set(range(100, 112)) and reasons(spark, pages(3, body) + real) == {}


def test_copies_of_a_page_that_says_something(spark):
    body = "The harbour froze early. Boats lay on the shore. Nobody came for weeks. Then the thaw took the pier, two sheds and the old crane down to the lower basin where they lie still."
    assert reasons(spark, pages(4, "Page not found. " + body, titles=False)) == {}


def test_known_residue_overruled(spark):
    text = "Please enable scripts to view this page."
    assert known(None, text)
    real = pages(9, lambda i: f"{text} In {'abcdefghi'[i]}ova they tell of the {'mnopqrstu'[i]}ull in the {'abcdefghi'[i]}ond.")
    assert reasons(spark, [*real, *pages(1, text, 50)]) == {}
    assert reasons(spark, [*real[:2], *pages(1, text, 50)]) == {50: "known"}


def test_title_alone_is_a_body():
    assert R.rest_of("Page not found") == [("page not found", False)] and R.rest_of("Hill of Dabu\n\nIt is steep.") == [("hill of dabu", True), ("it is steep.", False)]
    assert R.rest_of("Home | Search\nAll rights reserved") == []
