"""Forms of private data that stand in texts, and what must stay."""
from sourcinglens.llm.pii import replace_private

GONE = {"Dr. Anna Smith": ["Anna", "Smith"], "Mr. J. Smith": ["Smith"], "Mr. O'Brien": ["Brien"], "Mr John Ronald Tolkien": ["John", "Ronald", "Tolkien"],
        "Prof. Marie Smith-Jones": ["Marie", "Smith", "Jones"], "+1 555 123 4567": ["123 4567"], "+15551234567": ["1234567"], "555 123 4567": ["123 4567"],
        "020 7946 0958": ["7946"], "01 23 45 67 89": ["23 45 67"], "+49 (151) 1234 5678": ["1234 5678"], "API_KEY=abcd1234efgh": ["abcd1234"],
        'Password: "Hunter2hunter"': ["Hunter2"], "\"secret\": 'abcdefgh'": ["abcdefgh"]}
STAYS = ["the key: something", "Monday, 12 of 345", "Drama Smith", "1 234 567 people", "in 2001 2002 2003 it"]


def test_forms(spark):
    table = list(enumerate([*(f"so {t} then" for t in GONE), *STAYS]))
    mentions = ["Mrs Smith came. Smith left with Smith's dog; Smithson stayed.", "Smith saw Dr Anna Smith. Anna Smith slept.", "Smith left."]
    table += [(100 + i, t) for i, t in enumerate(mentions)]
    got = {r.doc_id: r for r in replace_private(spark.createDataFrame(table, "doc_id long, text string"), "k").collect()}
    for i, (form, private) in enumerate(GONE.items()):
        assert not [p for p in private if p in got[i].text], (form, got[i].text)
        assert got[i].n_entities == 1 and got[i].text.startswith("so ") and got[i].text.endswith(" then"), (form, got[i].text)
    for i, text in enumerate(STAYS, len(GONE)):
        assert (got[i].text, got[i].n_entities) == (text, 0)
    name = got[100].text.split()[1]
    assert got[100].text == mentions[0].replace("Smithson", "#").replace("Smith", name).replace("#", "Smithson") and name != "Smith"
    assert got[101].text.split()[0] == name == got[101].text.split()[4][:-1] and got[101].n_entities == 3
    given = got[101].text.split()[3]
    assert got[101].text.endswith(f"{given} {name} slept.") and given != "Anna" and got[102].text == mentions[2]
