"""Boilerplate of hosts with few pages."""

from lotlens.llm import site_lines


def test_hosts_of_one_two_three_and_twelve_pages(spark):
    pages = [(100 * n + i, f"http://host{n}.org/{i}", f"<p>menu</p><p>own {i}</p>" + "<p>some</p>" * (i < 3)) for n in (1, 2, 3, 12) for i in range(n)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_lines.drop_site_lines(site_lines.html_pages(frame)).collect()}
    assert got == {100 * n + i: "menu\nown 0\nsome" if n == 1 else f"own {i}" for n in (1, 2, 3, 12) for i in range(n)}


def test_white_space_and_pages_without_host(spark, monkeypatch):
    monkeypatch.setattr(site_lines, "HOT", 3)
    rows = [(i, "http://a.b/x", f"<p>{menu}</p><p>own {i}</p><p>\t</p>") for i, menu in enumerate(("\tMenu", "Menu", "Menu\r\n\t", " Menu \x0b", "Menu", "Menu"))]
    rows += [(100 + i, None, "<p>Menu</p>") for i in range(50)]
    got = site_lines.drop_site_lines(site_lines.html_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted((r.page_id, r.n_lines, r.n_dropped, r.text) for r in got) == [(i, 2, 1, f"own {i}") for i in range(6)] + [(100 + i, 1, 0, "Menu") for i in range(50)]
