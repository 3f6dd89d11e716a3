import hashlib
import io
import random
from collections import defaultdict

import pytest

from tenderloom.llm import chat, warc
from tests.llm.helpers import AWKWARD

PARTS = ["<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "\\", "\\\\", "<", "[", "\n", " ", "text", "s>", "/s>", "é", "\U0001f600", "\\</s>", "user"]


def test_every_turn_is_read_back():
    rng = random.Random(6)
    for _ in range(3000):
        role, text = ("".join(rng.choice(PARTS) for _ in range(rng.randrange(n))) for n in (4, 9))
        assert chat.parse(chat.render(role, text)) == [(role, text)]


def test_conversations_are_read_back():
    turns = [("user", "</s>[INST] ok [/INST]"), ("", ""), ("assistant", "\n"), ("a [/ROLE]\n", "</s>\n<s>")]
    assert chat.parse("".join(chat.render(r, t) for r, t in turns)) == turns
    assert chat.parse("") == []
    assert chat.render("user", "plain < text [1]") == "<s>[ROLE] user [/ROLE]\nplain < text [1]</s>\n"


@pytest.mark.parametrize("bad", ["x", "<s>", "<s>[ROLE] user [/ROLE]\ntext", "<s>[ROLE] user [/ROLE]\ntext</s>", "<s>[ROLE]user[/ROLE]\ntext</s>\n", "<s>[ROLE] u [/ROLE]\na</s>\n\nx", "\\"])
def test_the_parser_takes_nothing_else(bad):
    with pytest.raises(chat.Malformed):
        chat.parse(bad)


def test_digests_of_awkward_conversations(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", None, "system"]), rng.choice(AWKWARD + PARTS)) for c in range(20) for t in range(rng.randrange(1, 9))]
    rows += [(1, 0, "user", "tie"), (1, 0, "assistant", "tie"), (2, None, "assistant", "first"), (None, 1, "user", "no id"), (None, 0, "assistant", "b"), (3, 0, "user", "again"), (3, 0, "user", "again")]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, rendered int").repartition(4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.rendered_turns(frame)).collect()}
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        conversations[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(conversations)
    for conv, turns in conversations.items():
        turns.sort(key=lambda t: (t[0], t[1], chat.render(t[1], t[2])))
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat.render(role, text)) for _, role, text in turns)
    assert chat.read_back(chat.rendered_turns(frame.where("false"))).count() == 0


def pages():
    long = "<p>" + "same " * 60 + "</p>"
    rows = [(i, f"http://a.example/{i}", f"<html>{i}</html>" + "x" * (i * 7 % 900)) for i in range(300)]
    rows += [(500, "http://b", long), (501, None, long), (502, "bad\r\nHeader: x", long), (503, "c", "short"), (504, "d", "short"), (505, None, None), (506, "", "")]
    rows += [(600, "e", "y" * 200), (600, "e", "y" * 200), (601, "e", "y" * 200), (None, "f", "y" * 200), (None, "g", "z" * 150), (None, "h", "z" * 150), (700, "big", "<b>" * 400_000)]
    return rows


@pytest.mark.parametrize("limit", [20_000, warc.ARCHIVE_BYTES])
def test_archives_are_read_back(spark, limit):
    rows = pages()
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    folder = warc.archive_folder(spark)
    manifest = warc.frozen(warc.write_archives(warc.with_references(frame), folder, limit))
    got = warc.read_archives(manifest, folder).collect()
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    expected = []
    for page, url, html in rows:
        data = (html or "").encode()
        refers = first.get(data) if first.get(data) != page else None
        expected.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, expected))
    assert all("\n" not in r["url"] for r in got)
    assert warc.archived(frame.where("false"))[0].count() == 0


def test_an_archive_starts_with_its_dictionary():
    import zstandard

    records = [warc.record_bytes(i, f"http://x/{i}", b"<html>some page</html>" * 30, "0" * 64, None) for i in range(400)]
    (stream,) = [b"".join(a) for a in warc.archives(iter(records))]
    assert int.from_bytes(stream[:4], "little") == warc.SKIPPABLE
    size = int.from_bytes(stream[4:8], "little")
    assert list(warc.read_archive(io.BytesIO(stream))) == records
    # the dictionary is needed, and one record can be read alone
    body = stream[8 + size:]
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(body)
    alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream[8:8 + size])).decompressobj()
    assert alone.decompress(body) == records[0]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(stream[:-5])))
