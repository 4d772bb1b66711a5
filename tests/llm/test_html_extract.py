import random
import time

import pytest

from pathloom.llm.html_extract import extract_html, main_text

SENTENCE = "It was the first of the days when they had to go to the house by the sea and wait for him there."
PARAGRAPHS = ["A title &amp; more", f"{SENTENCE} {SENTENCE}", "Of.", f"{SENTENCE}  &eacute;&#233;\n {SENTENCE}", "Odd### *** lines %%% " * 8, SENTENCE * 3]
WANT = "\n".join(" ".join(x.replace("&amp;", "&").replace("&eacute;", "é").replace("&#233;", "é").split()) for x in PARAGRAPHS)
BODY = f"<h1>{PARAGRAPHS[0]}</h1>" + "".join(f"<p>{x}" for x in PARAGRAPHS[1:])
NAV = '<nav><ul><li><a href="/a">The one</a><li><a href="/b">And two</a></ul></nav>'
AROUND = [
    NAV,
    f"<header><p>{SENTENCE}</p></header>",
    f'<div class="ad">{SENTENCE} {SENTENCE}</div>',
    f'<aside class="sidebar"><p>{SENTENCE}</p></aside>',
    f'<div id="cookie-notice"><p>{SENTENCE * 3}</p></div>',
    f'<form><label>{SENTENCE}</label><select><option>x</select></form>',
    f"<script>var t='</p><article>{SENTENCE}';</script><style>p{{}}</style><!-- <p>{SENTENCE}</p> -->",
    f'<section class="comments"><p>{SENTENCE * 3}</p></section>',
    f"<footer>&copy; {SENTENCE}</footer>",
]


@pytest.mark.parametrize("seed", range(10))
@pytest.mark.parametrize("container", ["<article>{}</article>", "<main>{}</main>", "<article>{}", "<main><article class='post'>{}</article></main>"])
def test_marked_article(seed, container):
    rng = random.Random(seed)
    around = rng.sample(AROUND, 6)
    page = "<!DOCTYPE html><html><head><title>The t</title></head><body>" + "".join(around[:3]) + container.format(BODY)
    if "</" in container:
        page += "".join(around[3:]) + "</body></html>"
    assert main_text(page) == WANT


@pytest.mark.parametrize("seed", range(10))
def test_unmarked_page(seed):
    rng = random.Random(seed)
    around = rng.sample(AROUND, 6)
    texts = [PARAGRAPHS[0], *PARAGRAPHS[1:4], PARAGRAPHS[5]]
    body = f"<div><h1>{texts[0]}</h1>" + "".join(f"<p>{x}</p>" for x in texts[1:]) + "</div>"
    page = "<html><body>" + "".join(around[:3]) + body + "".join(around[3:])
    assert main_text(page) == "\n".join(x for x in WANT.split("\n") if "###" not in x)


def test_inline_marks_breaks_and_furniture_in_the_article():
    page = f"<article><p>{SENTENCE}<b>b</b>old<br>next {SENTENCE}</p><div class='share'>Share it with the world and all of them</div><p>End <a href='x'>here</a>.</p></article>"
    assert main_text(page) == f"{SENTENCE}bold next {SENTENCE}\nEnd here."


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 3), (2, None, "", 3), (3, "v", f"<article>{BODY}</article>", 3), (3, "v", f"<article>{BODY}</article>", 3), (4, "w", "<p" * 500, 3)], "page_id long, url string, html string, text int")
    rows = {r.page_id: r for r in extract_html(df).collect()}
    assert [rows[i].text for i in (1, 2, 3)] == ["", "", WANT] and rows[3].n_chars == len(WANT)
    assert extract_html(df).count() == 5 and extract_html(df.limit(0)).count() == 0


FOREIGN = [
    ["Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita.", "Ahi quanto a dir qual era è cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura!"],
    ["Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.", "Все смешалось в доме Облонских. Жена узнала, что муж был в связи с бывшею в их доме француженкою-гувернанткой."],
    ["话说天下大势,分久必合,合久必分。周末七国分争,并入于秦。及秦灭之后,楚、汉分争,又并入于汉。", "汉朝自高祖斩白蛇而起义,一统天下,后来光武中兴,传至献帝,遂分为三国。推其致乱之由,殆始于桓、灵二帝。"],
]


@pytest.mark.parametrize("texts", FOREIGN)
def test_unmarked_page_in_another_language(texts):
    links = "<div>" + "".join(f"<a href='/{i}'>{texts[0]}</a> " for i in range(3)) + "</div>"
    page = f"<html><body>{NAV}{links}<div>{''.join(f'<p>{x}</p>' for x in texts)}</div>{AROUND[2]}<p>{'=*= ' * 40}</p></body></html>"
    assert main_text(page) == "\n".join(texts)


def test_unmarked_page_with_a_paragraph_of_names():
    names = "Anna Schmidt, Bernardo Costa, Chiara Bianchi, Dmitri Ivanov, Elif Yilmaz, Farid Haddad, Grace Okafor, Hiro Tanaka."
    page = f"<html><body>{NAV}<p>{SENTENCE} {SENTENCE} {SENTENCE}</p><p>{names}</p><p>{SENTENCE} {SENTENCE} {SENTENCE}</p></body></html>"
    assert names in main_text(page).split("\n")


STORY = ["The old harbour was empty when the boats came back from the long night at sea and all of the men were tired.", "Nobody had seen the light on the rocks, and it was only by chance that the last of them turned in time to be safe."]


@pytest.mark.parametrize("attrs", ['class="post share-enabled"', 'class="entry comment-count-3"', 'id="search-results-article"', 'class="comments-closed story"'])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_of_states_are_no_furniture(tag, attrs):
    page = f"<html><body><nav>Home | News</nav><{tag} {attrs}>" + "".join(f"<p>{x}</p>" for x in STORY) + f"</{tag}></body></html>"
    assert main_text(page) == "\n".join(STORY)


@pytest.mark.parametrize("name", ["site-footer", "main-nav", "sidebar-left", "cookie-banner", "related-posts", "comment-list", "comment-body", "page-header"])
def test_names_of_furniture(name):
    page = "<body><div>" + "".join(f"<p>{x}</p>" for x in STORY) + f'</div><div class="{name}"><p>{STORY[0][::-1]} the and of to in is it was</p></div></body>'
    assert main_text(page) == "\n".join(STORY)


def test_a_teaser_is_not_the_article():
    page = "<body><div>" + "".join(f"<p>{x}</p>" for x in STORY) + '</div><article class="teaser"><p>Read this short one.</p></article></body>'
    assert STORY[0] in main_text(page) and STORY[1] in main_text(page)


def test_unlisted_languages():
    polish = "Stary port był pusty, kiedy łodzie wróciły z długiej nocy na morzu, a wszyscy ludzie byli bardzo zmęczeni i głodni."
    chinese = "渔船在漫长的黑夜之后终于回到了港口,所有的人都非常疲惫,没有人看到礁石上的灯光,只有最后一条船及时转向才得以平安归来。"
    for text in (polish, chinese):
        assert main_text(f"<body><div class='nav'>a b</div><div><p>{text}</p><p>{text[::-1]}</p></div></body>") == f"{text}\n{text[::-1]}"


def test_broken_pages_take_linear_time():
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        assert main_text("<p>" + "<b>x</i>" * n) is not None
        assert main_text("<ul>" + "<li><i>" * n) is not None
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1
