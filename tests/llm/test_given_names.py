"""People of one surname keep distinct surrogates."""

from examlattice.llm import pii


def test_given_names_of_one_surname_stay_distinct(spark):
    names = [f"{a}{b}{c}" for a in "ABDEG" for b in "aeio" for c in ("lan", "nor", "rik")]
    people = [f"Mr {n} Smith" for n in names] + [f"Dr {n} Smith" for n in names[:20]] + ["Господин Иван Петров", "Господин Пётр Петров", "Mr Smith"]
    docs = spark.createDataFrame([*enumerate(people), (500, "MR".title() + " " + names[0] + " Jones met Mr " + names[0] + " Smith")], "doc_id long, text string")
    text = {r.doc_id: r.text for r in pii.pseudonymise(docs, "key").collect()}
    print("people", len(people), "distinct surrogates", len({text[i] for i in range(len(people))}))
    assert len({text[i] for i in range(len(people))}) == len(people)
    surnames = {text[i].rsplit(" ", 1)[1] for i, p in enumerate(people) if p.endswith("Smith")}
    assert len(surnames) == 1 and text[500].endswith(text[0]) and text[500].split()[1] == text[0].split()[1]
    assert all(len(text[i].split()) == len(p.split()) for i, p in enumerate(people))
