import html
import re

import pytest
from pyspark.sql import functions as F

from clewline.llm import html_text as h

LONG = "The text of the article is in this place and it is of some length for the test that we have here, and it goes on and on until it is over two hundred characters long, which it will be in a while, as it is so."


def test_given_pages(spark):
    """In the given pages the article is marked, so a plain reading of its blocks is the answer."""
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r.page_id: r for r in h.op7(spark, folder).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert got[i].text == "\n".join(p for p in parts if p) and got[i].n_chars == len(got[i].text)


@pytest.mark.parametrize("around", [
    "<nav><p>{}</p></nav>", "<header><p>{}</p></header>", "<footer>{}</footer>", "<aside><div>{}</div></aside>", "<form><p>{}</p></form>",
    '<div class="ad">{}</div>', '<div class="cookie-notice"><p>{}</p></div>', "<div id='sidebar'>{}</div>", "<section class=comments><article><p>{}</p></article></section>",
    "<script>{}</script>", "<style>{}</style>", "<!-- {} -->", "<noscript>{}</noscript>", "<template><p>{}</p></template>", "<textarea>{}</textarea>", '<div hidden>{}</div>',
    '<div style="display:none">{}</div>', "<button>{}</button>", "<select><option>{}</option></select>", '<span class="ad">{}</span>', '<div role="navigation">{}</div>'])
@pytest.mark.parametrize("frame_", ["<article><p>{0}</p>{1}<p>Short end.</p></article>", "<body><p>{0}</p>{1}</body>", "<body>{1}<article><p>{0}</p></article></body>", "<main>{1}<h1>{0}</h1></main>"])
def test_surroundings_go(around, frame_):
    noise = "It is of the noise that is in the page and not of the text " * 5
    got = h.extract(frame_.format(LONG, around.format(noise)))
    assert LONG in got and "noise" not in got


def test_short_blocks_follow_their_neighbours():
    links = "".join(f'<li><a href="/{k}">Some link to a page of the site {k}</a></li>' for k in range(5))
    assert h.extract(f"<body><ul>{links}</ul><div>Top</div><ul>{links}</ul><h2>Head</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></body>") == f"Head\n{LONG}\nYes.\n{LONG}"


def test_references_and_white_space():
    assert h.extract("<article><p>Caf&eacute; &amp;\n\t more&nbsp;&#39;x&#x27; &lt;b&gt; &unknown;</p><p> a<b>b</b> c<br>d </p></article>") == "Café & more 'x' <b> &unknown;\nab c d"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<script>x", "<!-- x", "<a title='" * 300, "<div " * 3000, "</p></div>", "&", "<title>t</title>", "<nav>" * 3000])
def test_odd_pages_are_empty_or_text(page):
    assert h.extract(page) in ("", "&", "<")


def test_long_page_and_unclosed_elements():
    assert h.extract("<article>" + f"<p>{LONG}" * 500) == "\n".join([LONG] * 500)
    assert h.extract("<nav><p>menu<article><p>" + LONG) == LONG


def test_other_columns(frame):
    df = frame([(1, None, "x"), (1, None, "x"), (2, f"<p>{LONG}</p>", None)], "page_id bigint, html string, text string")
    got = sorted((r.page_id, r.main, r.text or "") for r in df.withColumn("main", h.main_text(F.col("html"))).collect())
    assert got == [(1, "", "x"), (1, "", "x"), (2, LONG, "")]
    assert df.where("false").select(h.main_text(F.col("html"))).collect() == []


PROSE = {
    "en": "City officials said Tuesday that construction of the new bridge will begin next spring, following months of delays over funding. Mayor Ellen Carter told reporters the project, estimated at 42 million dollars, remains a top priority and will create hundreds of local jobs across the region.",
    "en technical": "Compressed column chunks are stored contiguously, so readers fetch only required byte ranges from object storage. Each row group carries min and max statistics, allowing query engines to skip blocks whose values fall outside filter predicates. Dictionary encoding further reduces storage.",
    "en recipe": "Preheat oven to 180 degrees. Whisk eggs, sugar and melted butter until pale, then fold in flour, baking powder and grated lemon zest. Pour batter into a greased tin, bake for 35 minutes until golden, and cool on a wire rack before slicing. Serve with cream or fresh berries.",
    "it": "Il governo ha approvato ieri il nuovo decreto che prevede aiuti alle famiglie colpite dalle alluvioni. Secondo il ministro, le risorse saranno disponibili entro la fine del mese, mentre i comuni dovranno presentare l'elenco dei danni e delle strade da ricostruire prima dell'inverno.",
    "ru": "Правительство объявило в понедельник о новой программе поддержки малого бизнеса, которая начнёт действовать с первого января. По словам министра, предприятия смогут получить льготные кредиты на закупку оборудования, а также субсидии на обучение сотрудников в регионах страны.",
    "tr": "Belediye başkanı pazartesi günü yaptığı açıklamada yeni köprünün inşaatının gelecek baharda başlayacağını söyledi. Yaklaşık kırk milyon avroya mal olması beklenen proje, bölgede yüzlerce kişiye iş imkânı sağlayacak ve ulaşım süresini önemli ölçüde kısaltacak.",
    "pl": "Burmistrz ogłosił w poniedziałek, że budowa nowego mostu rozpocznie się wiosną przyszłego roku, po wielu miesiącach opóźnień. Według urzędników projekt będzie kosztował około czterdziestu milionów euro i stworzy setki miejsc pracy w całym regionie, a czas przejazdu się skróci.",
    "el": "Ο δήμαρχος ανακοίνωσε τη Δευτέρα ότι η κατασκευή της νέας γέφυρας θα ξεκινήσει την επόμενη άνοιξη, μετά από μήνες καθυστερήσεων. Το έργο αναμένεται να κοστίσει περίπου σαράντα εκατομμύρια ευρώ και να δημιουργήσει εκατοντάδες θέσεις εργασίας στην περιοχή.",
    "zh": "市长周二宣布,新桥的建设将于明年春天开始,此前因资金问题推迟了数月。该项目预计耗资四千万欧元,将为该地区创造数百个就业岗位,并缩短前往市中心的时间。官员们表示,工程期间交通将受到一定影响,市民可以通过市政府网站了解最新的安排和绕行路线。",
}
LINKS = "<ul>" + "".join(f'<li><a href="/{k}">Some link to a page of the site {k}</a></li>' for k in range(5)) + "</ul>"
NAMES = "<div>" + "Laptops Phones Cameras Audio Gaming Tablets Printers Monitors Keyboards Storage Networking Software Drones Wearables Televisions Projectors Headphones Speakers Chargers Cables Batteries Routers Modems Scanners" + "</div>"


@pytest.mark.parametrize("language", PROSE)
def test_plain_prose_without_article(language):
    p = PROSE[language]
    half = p[: len(p) // 2]  # a middling paragraph
    assert h.extract(f"<body>{LINKS}<div>{p}</div><div>{p}</div>{LINKS}</body>") == f"{p}\n{p}"
    assert h.extract(f"<body>{LINKS}<p>{half}</p><p>{half}</p><p>{half}</p>{LINKS}</body>").count(half.strip()) == 3
    assert h.extract(f"<body>{LINKS}<p>{half}</p><p>{half}</p><p>{p}</p>{LINKS}</body>").count(half.strip()) == 3


def test_lists_of_names_are_not_prose():
    assert h.extract(f"<body>{NAMES}{LINKS}<p>{PROSE['en']}</p><p>{PROSE['it']}</p><p>{PROSE['zh']}</p>{LINKS}{NAMES}</body>") == "\n".join(PROSE[k] for k in ("en", "it", "zh"))


@pytest.mark.parametrize("page", [
    '<body class="single comments-open"><article>{}</article></body>', '<body class="sidebar-left hidden"><p>{}</p></body>', '<article class="post has-comments">{}</article>',
    '<main class="overflow-hidden">{}</main>', '<article class="sm:hidden md:block">{}</article>', '<div class="hidden md:block">{}</div>', '<div class="has-sidebar">{}</div>', '<div class="no-sidebar"><p>{}</p></div>',
    '<div class="navbar-offset">{}</div>', '<main class="sidebar-layout"><article>{}</article></main>', '<article class="post tag-cookies category-social">{}</article>',
    '<div id="comments-wrapper"><main><p>{}</p></main></div>', '<div class="widget"><div class="content-header"><p>{}</p></div></div>', '<article class="post header-video">{}</article>'])
@pytest.mark.parametrize("noise", [
    "", '<div class="sidebar"><p>noise noise noise</p></div>', '<nav><p>noise of the site and of the page</p></nav>',
    '<section id="comments"><article class="comment"><p>' + "This is the noise of a reader and it is as long as it can be. " * 20 + "</p></article></section>"])
def test_names_that_do_not_hide_the_text(page, noise):
    inside = page.replace("{}", "{}" + noise)
    assert h.extract(page.format(LONG) + noise) == LONG
    assert h.extract(inside.format(LONG)) == LONG


def test_related_articles_go():
    cards = "".join(f'<article class="related-card"><p>It is of the noise that is on the page {k}</p></article>' for k in range(4))
    assert h.extract(f"<article><p>{LONG}</p></article>{cards}") == LONG
    assert h.extract(f'<article class="post has-comments"><p>{LONG}</p><div class="related">{cards}</div></article>') == LONG


ENGLISH = "This is a paragraph of ordinary English prose that the reader came for, and it goes on for a while so that it is clearly a block of the main text in the page. " * 2


def test_a_page_inside_a_form():
    assert h.extract(f"<body><form><div><label>Search</label><p>{ENGLISH}</p><p>{ENGLISH}</p></div></form></body>").count("ordinary") == 4
    assert "news" not in h.extract(f"<article><p>{ENGLISH}</p><form><p>Subscribe to the news and get the best of it by mail on every day of the week, free for all of the readers</p></form></article>")


def test_teasers_are_not_the_article():
    teaser = "<section><article><p>A short teaser of about eighty characters that says what another page is about.</p></article></section>"
    assert h.extract(f"<div class=story><p>{ENGLISH}</p><p>{ENGLISH}</p><p>{ENGLISH}</p></div>{teaser}").count("ordinary") == 6


def test_sections_named_like_subjects():
    for name in ("social-history", "related-work", "binary-search", "warning"):
        page = f"<article><p>{ENGLISH}</p><section class='{name}'><p>special {ENGLISH}</p></section><p>{ENGLISH}</p></article>"
        assert "special" in h.extract(page), name
        links = f"<article><p>{ENGLISH}</p><div class='{name}'><a href=1>linky one</a> <a href=2>linky two</a></div><p>{ENGLISH}</p></article>"
        assert "linky" not in h.extract(links), name
    for name in ("ad", "newsletter", "comments", "cookie-notice"):
        assert "special" not in h.extract(f"<article><p>{ENGLISH}</p><section class='{name}'><p>special {ENGLISH}</p></section><p>{ENGLISH}</p></article>"), name


def test_signs_inside_an_article():
    assert "©" in h.extract(f"<article><p>{ENGLISH}</p><p>© is the sign that this paragraph begins with, and it is of the article, so that it has to stay for the reader of it.</p><p>{ENGLISH}</p></article>")
