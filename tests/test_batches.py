import pyarrow as pa

from pagemill.sources.html import parsed


def test_output_batches_are_bounded():
    """A worker's memory goes by its output batches: 4,000 pages in one batch must leave it in small ones."""
    page = "<html><body>" + "".join(f'<p class="a b">text <a href="/p{i}">link {i}</a></p>' for i in range(20)) + "</body></html>"
    big = "<p>" + "x" * 3_000_000
    htmls = [page] * 2000 + [None, "", big] + [page] * 2000
    batch = pa.record_batch([pa.array(range(len(htmls))), pa.array(htmls)], names=["page_id", "html"])
    found = list(parsed([batch], "html", ["page_id"]))
    assert [i for b in found for i in b.column(0).to_pylist()] == list(range(len(htmls)))
    assert max(b.nbytes for b in found if 2002 not in b.column(0).to_pylist()) < 4_000_000
    sizes = [len(nodes) for b in found for nodes in b.column(1)]
    assert sizes[2000:2002] == [0, 0] and len(set(sizes[:2000] + sizes[2003:])) == 1


def test_no_pages_give_no_batch():
    batch = pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.string())], names=["page_id", "html"])
    assert list(parsed([batch], "html", ["page_id"])) == []
