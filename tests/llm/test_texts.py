"""Sampling, parsing, formatting copies, pair defects, tokens, leaks and sentences."""

import ast
import os
import random
from collections import Counter

import pytest
import regex
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from evalframe.llm import bpe_automaton as bpe, leak_suffix as leak
from evalframe.llm.answers import parse_answer
from evalframe.llm.derivatives import Grammar
from evalframe.llm.format_duplicates import answer_fields, code_fields, format_classes
from evalframe.llm.grammars import language
from evalframe.llm.pair_defects import answer_defects, pair_defects
from evalframe.llm.quota_sample import Target, controlled_rounding, quota_sample, quotas, target_report
from evalframe.llm.sentences import sentence_spans, sentences
from evalframe.llm.source_parse import parse_failure, parse_rates, unparsable_files

# sampling


@given(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 4)), st.floats(0, 9), min_size=1, max_size=20))
@settings(max_examples=80, deadline=None)
def test_controlled_rounding(table):
    caps = {k: 10 for k in table}
    out = controlled_rounding(table, caps)
    for k, x in table.items():
        assert abs(out[k] - x) < 1 + 1e-6
    for axis in (0, 1):
        for line in {k[axis] for k in table}:
            assert abs(sum(v for k, v in out.items() if k[axis] == line) - sum(v for k, v in table.items() if k[axis] == line)) < 1 + 1e-6


ORACLE = "oracle_id long, difficulty string, tags array<string>, source string, mask int"
TARGETS = [("difficulty", "easy", 0.5, 1), ("difficulty", "hard", 0.5, 3), ("source", "A ", 0.4, 1), ("tags", "graphs", 0.3, 2), ("tags", "rare", 0.01, 5)]


def oracle_rows(n):
    rng = random.Random(1)
    return [(i, rng.choice(["easy", " Easy", "HARD", "mid", None]), rng.choice([[], None, ["Graphs"], ["graphs ", "graphs"], ["dp", None]]), rng.choice(["a", "A", "b", None]), 7) for i in range(n)]


def test_sample(spark):
    rows = oracle_rows(1000)
    df, t = spark.createDataFrame(rows, ORACLE), spark.createDataFrame(TARGETS, "dimension string, category string, target_share double, min_rows long")
    sample, report = quota_sample(df, t)
    got = sample.collect()
    assert len({r.id for r in got}) == len(got) == 200
    by = {(r.dimension, r.category): r for r in report.collect()}
    assert by["difficulty", "easy"].available == sum((d or "").strip().lower() == "easy" for _, d, *_ in rows)
    assert by["tags", "graphs"].available == sum(any((x or "").strip().lower() == "graphs" for x in (ts or [])) for _, _, ts, *_ in rows)
    drawn = Counter((r.difficulty or "-") for r in got)
    assert drawn["easy"] == by["difficulty", "easy"].sampled and drawn["hard"] == by["difficulty", "hard"].sampled
    assert by["difficulty", "easy"].met and by["difficulty", "hard"].met and not by["tags", "rare"].met
    assert {r.id for r in quota_sample(df, t)[0].collect()} == {r.id for r in got}
    unmet = {(r.dimension, r.category) for r in target_report(df, t).where("not met").collect()}
    assert unmet == {("tags", "rare")}


def test_sample_edges(spark):
    df, t = spark.createDataFrame([], ORACLE), spark.createDataFrame(TARGETS, "dimension string, category string, target_share double, min_rows long")
    sample, report = quota_sample(df, t)
    assert sample.count() == 0 and report.where("met").count() == 0
    none = spark.createDataFrame([], "dimension string, category string, target_share double, min_rows long")
    assert target_report(df, none).count() == 0
    assert quota_sample(spark.createDataFrame(oracle_rows(50), ORACLE), none)[0].count() == 10


def test_quotas_take_all_of_a_scarce_category():
    counts = {("easy", "a", 0): 90, ("hard", "a", 0): 5, ("easy", "b", 1): 5}
    q = quotas(counts, [Target("difficulty", "hard", 50, 1), Target("tags", "t", 20, 1)], ["t"], 20)
    assert sum(q.values()) == 20 and q["hard", "a", 0] == 5 and all(q[k] <= counts[k] for k in q)


# parsing


def test_grammar_derivatives():
    g = Grammar("unit = '(' unit ')' unit | NAME unit | 'x'?\n", "unit")
    k = g.kinds
    enc = lambda s: [k[{"n": "NAME"}.get(c, c)] for c in s]
    assert g.failure(enc("(n(x))n")) is None and g.failure([]) is None
    assert g.failure(enc("(n")) == 2 and g.failure(enc("n)n")) == 1 and g.failure(enc("xx")) == 1


PY_GOOD = [
    "x = 1\n", "def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n\treturn [i for i in a if i]\n", "async def f():\n  async with a as b, c: await d\n", "match x:\n case {'a': [1, *_], **r} if r: pass\n case A(b=1) | None: y\n", "class A(B, metaclass=C):\n  x: int\n  @p.q\n  def f(self): ...\n",
    "try:\n  pass\nexcept* (A, B) as e: raise X from e\nelse: pass\nfinally: z = lambda *a, **k: (yield)\n", "print(f'{a!r:>{w}}', rb'x' b'y', sep=' ')", "a = b = c, *d = e\n", "x[1:2, ::3, ...] = {**a, 'b': 1} if not c is d else {1, 2}\n", "if (n := 10) > 5: pass\nelif a: pass\nelse: pass", "type X[T: int] = list[T]\n",
    "with (open(a) as f, g): pass\n", "from . import (a as b, c,)\nimport d.e as f, g\n", "x = (1\n  + 2)\n# end", "for i, in x: continue\nelse: del a[0], b\n", "match = case = type = 1\nprint(match)\n", "'''doc\n'''\n\n", "a = 0x_F + 1_0.5e-3j if 1or 2 else .5\n", "def f(): return\n\n\n  # odd comment\nx=1;y=2;\n",
]
PY_BAD = ["def f(:\n", "x = (1\n", "if x:\npass\n", "  x = 1\n", "print 'a'\n", "def f():\n\tx\n        y\n", "a = 'x\n", "<<<<<<< ours\n", "for x in y\n  z\n", "return = 1\n", "x = 1 +\n", "else: pass\n", "import java.util.*;\n", "a b\n", "f(a b)\n", "```python\nx\n```\n", "x = 08 9\n"]


@pytest.mark.parametrize("code", PY_GOOD)
def test_python_good(code):
    ast.parse(code)
    assert language("python3").failure(code) is None and parse_failure(code, "python3") is None


@pytest.mark.parametrize("code", PY_BAD)
def test_python_bad(code):
    with pytest.raises(SyntaxError):
        ast.parse(code)
    assert parse_failure(code, "python3")


CPP_GOOD = [
    "#include <bits/stdc++.h>\nusing namespace std;\nint main(){vector<vector<int>>v(3,vector<int>(4));for(auto&[a,b]:m)cin>>a;return 0;}",
    "template<typename T,class...A>struct S:public B<T>{S():x(1),y{2}{}~S()=default;T operator()(const T&a)const noexcept{return a<b?c:d;}private:int x,y=3;};",
    "auto f=[&,x=1](int a)mutable->int{return a>>1;};constexpr int N=1e5+7;long long a[N][2],*p=&a[0][0];", "enum class E:int{A,B=2};typedef pair<int,int>pii;using ll=long long;namespace n{int x;}",
    "int main(){string s=R\"(a\"{)\";char c='\\'',d='{';// {\n/* } */do{x--;}while(x>0);switch(x){case 1:case 2:break;default:;}goto e;e:return 0;}", "int f(int(*g)(int),int a[],...);struct{int a;}t={.a=1};static const unsigned long long M=0xFFull;",
    "int main(){priority_queue<int,vector<int>,greater<int>>q;sort(v.begin(),v.end(),[](const auto&a,const auto&b){return a.first<b.first;});a=b=c;if(int x=f();x>0)throw runtime_error(\"x\" \"y\");}", "void g(){for(;;){if(a)b;else if(c){}else d;}try{f();}catch(const exception&e){}catch(...){}x=(double)y/(1LL<<3);delete[]p;int*q=new int[5]{};}",
]
CPP_BAD = ["int main(){", "int main(){cin>>x}", "int main(){int x=;}", "<<<<<<< a\nint x;", "int main(){return 0;}}", "def f(x):\n  return x", "int main(){f(1,);}", "int main(){char c='{;}", "# Heading\nint x;", "int main(){if x>1 return;}", "int a b;", "public class A{public static void main(String[] a){}}", "int main(){/* }"]


@pytest.mark.parametrize("code", CPP_GOOD)
def test_cpp_good(code):
    assert parse_failure(code, "cpp17") is None


@pytest.mark.parametrize("code", CPP_BAD)
def test_cpp_bad(code):
    assert parse_failure(code, "cpp17")


JAVA_GOOD = [
    "import java.util.*;\npublic class Main{static<T extends Comparable<T>>int f(T a,int...b)throws Exception{return a.compareTo(null)>0?1:2;}public static void main(String[] args){Scanner in=new Scanner(System.in);int[][] d=new int[3][];for(int x:d[0]){}List<Map<String,int[]>>l=new ArrayList<>();}}",
    "package a.b;enum E{A(1){void g(){}},B;private int x=1;E(int...y){}}interface I<T>{default void f(){}int g();}", "class A{int x=1>>>2,y[]={1,2,};{x++;}static{f();}Runnable r=()->{};java.util.function.Function<Integer,Integer>g=(a)->a+1,h=Integer::valueOf;}",
    "record P(int a,String b){P{if(a<0)throw new X();}}sealed interface S permits P{}", "class A{void f(){switch(x){case 1->g();case 2,3->{}default->h();}var s=\"\"\"\n a\"b\n\"\"\";try(var r=q()){}catch(A|B e){}finally{}label:for(;;)break label;if(o instanceof String t&&t.length()>1)synchronized(this){}long v=(long)a*b;char c='\\u0041';}}",
]
JAVA_BAD = ["public class Main{", "class A{int x}", "class A{void f(){int x=1 int y;}}", "class A{void f(){>>>>>>> b\n}}", "import sys\nx=1", "class A{void f(){System.out.println(\"a);}}", "#include <x>\nint main(){}", "class A{}}", "class A{void f(){return x;"]


@pytest.mark.parametrize("code", JAVA_GOOD)
def test_java_good(code):
    assert parse_failure(code, "java") is None


@pytest.mark.parametrize("code", JAVA_BAD)
def test_java_bad(code):
    assert parse_failure(code, "java")


def test_truncation_is_told_apart():
    assert parse_failure("int main(){", "cpp17") == (11, True) and parse_failure("int main(){)", "cpp17") == (11, False)


def test_parse_tables(spark):
    rows = [(1, "int main(){}", "cpp17", "r"), (2, "int main(){", "cpp17", "r"), (3, None, "java", "r"), (4, " \n", "java", None), (5, "nonsense here", "unknown", "r"), (6, "nonsense here", None, "r"), (7, "x = (", "python3", None), (7, "x = (", "python3", None), (None, "x = (", "python3", None), (8, "x=1\n" * 20000, "python3", "q")]
    df = spark.createDataFrame(rows, "solution_id long, code string, language string, repo string").withColumns({"id": F.lit(1), "failed_at": F.lit(2)})
    assert sorted((r.id is None, r.id or 0) for r in unparsable_files(df).collect()) == [(False, 2), (False, 7), (False, 7), (True, 0)]
    rates = {(r.repo, r.language): (r.files, r.unparsable, r.truncated, r.rate) for r in parse_rates(df).collect()}
    assert rates["r", "cpp17"] == (2, 1, 1, 0.5) and rates[None, "python3"][:2] == (3, 3) and rates["r", None] == (1, 0, 0, 0.0)
    assert unparsable_files(df.limit(0)).count() == 0


# formatting copies and pair defects

CODE = "#include <bits/stdc++.h>\nint main() {\n    return 0;\n}"
GOOD = f"Solution Explanation:\n本题使用线段树求解。原题说“It costs 5”。\n\nTime Complexity: O(n log n)\nSpace Complexity: unknown\n```cpp\n{CODE}\n```"
DRESSED = f"**Space Complexity** - UNKNOWN\r\n```c++\r\n{CODE.upper().replace(' ', '')}\r\n```\r\n## solution explanation\r\n本题使用线段树求解.原题说 it COSTS 5\r\n\r\ntime complexity：o ( nlogn)\r\n"


def test_fields():
    assert answer_fields(GOOD) == answer_fields(DRESSED) and answer_fields(GOOD)[1] == "onlogn"
    assert answer_fields(GOOD.replace("\n```", "", 1)) is None and answer_fields(GOOD.removesuffix("```")) is None and answer_fields(None) is None and answer_fields("") is None
    assert parse_answer(DRESSED).order == ["space", "code", "explanation", "time"]
    assert code_fields("a" * 29) is None and code_fields("A b_c" * 10) == code_fields("abc" * 10)


def test_format_classes(spark):
    long = "x1 = y2 + z3; " * 5
    rows = [(3, long), (1, long.upper()), (2, long.replace(" ", "\n")), (4, long + "w"), (5, None), (6, "short"), (7, ""), (None, long), (8, "ab" * 20), (9, "ba" * 20), (1, long)]
    df = spark.createDataFrame(rows, "sid long, code string").withColumns({"id": F.lit("x"), "hist": F.lit(0), "n": F.lit(1)})
    got = sorted((r.id, r.kept_id, r.copies) for r in format_classes(df, "sid", "code").collect())
    assert got == [(1, 1, 4), (1, 1, 4), (2, 1, 4), (3, 1, 4)]
    assert format_classes(df.limit(0), "sid", "code").count() == 0
    hot = spark.range(2000).select(F.col("id").alias("sid"), F.when(F.col("id") % 3 == 0, F.lit(long)).otherwise(F.concat(F.lit(long), F.col("id").cast("string"))).alias("code"))
    assert format_classes(hot, "sid", "code").agg(F.count("*"), F.max("kept_id"), F.max("copies")).first()[:] == (667, 0, 667)


PROMPT = "Title: A\n\nThe gilded machine in the bazaar can balance 33 wells, after which Cloul waits. The player who cannot shift a stone loses points."


@pytest.mark.parametrize("text, want", [
    (None, ["empty"]), (" \n", ["empty"]), ("N/A", ["empty"]), ("Solution Explanation:\n...", ["empty"]), ("Solution Explanation:\n\nTime Complexity: \nSpace Complexity: \n```cpp\n```", ["empty"]), ("```cpp\n\n```", ["empty"]),
    (PROMPT, ["copies_prompt", "truncated"]), ("Solution Explanation:\n" + PROMPT.upper().replace("CAN", "really can") + "\n\nTime Complexity: unknown\nSpace Complexity: unknown", ["copies_prompt", "truncated"]),
    ("I'm sorry, but I can't help with this.", ["refusal", "truncated"]), ("抱歉，我无法解答关于这道题。", ["refusal", "truncated"]), ("Lo siento, no puedo resolver el problema x.", ["refusal", "truncated"]),
    ("Solution Explanation:\n为什么弥汀的传感", ["truncated"]), (GOOD[: GOOD.index("return")], ["truncated"]), (GOOD[: GOOD.index("return")] + "\n```", ["truncated"]), (GOOD[: GOOD.index("log")], ["truncated"]),
    (GOOD, []), (DRESSED, []), (GOOD.removesuffix("\n```"), []), (GOOD.replace("本题使用线段树求解。", "Die Lösung von Dr. Jeirk braucht ca. 27 s für alle Knoten im Fall."), ["other_language"]),
    (GOOD.replace("本题使用线段树求解。", "制約は31768以下なので、O(n + m)でも十分だ。"), ["other_language"]), (GOOD.replace("线段树", "抱歉，无法解答的线段树"), []),
])
def test_answer_defects(text, want):
    assert answer_defects(text, PROMPT) == want


def test_pair_defects(spark):
    df = spark.createDataFrame([(1, None, GOOD, None), (2, " ", "x " * 100_000, GOOD), (3, PROMPT, PROMPT, GOOD), (3, PROMPT, PROMPT, GOOD), (None, "p", GOOD, GOOD)], "pair_id long, prompt string, chosen string, rejected string").withColumn("defect", F.lit(1))
    got = Counter((r.pair_id, r.field, r.defect) for r in pair_defects(df).where("rule_order = 1").collect())
    assert got == {(1, "prompt", "empty"): 1, (1, "rejected", "empty"): 1, (2, "prompt", "empty"): 1, (2, "chosen", "truncated"): 1, (3, "chosen", "copies_prompt"): 2}
    assert pair_defects(df.limit(0)).count() == 0


# tokens

VOCAB = "/opt/tokenizers/byte_bpe_50k.json"
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary here")


@pytest.fixture(scope="module")
def machine():
    return bpe.Transducer(bpe.MergeAutomaton(*bpe.read_vocabulary(VOCAB)))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@needs_vocab
@pytest.mark.parametrize("text", ["", "Hello world's  end\n\n \t x", "<|endoftext|>", "aaaaaaaaaaaaaaa baaaaab", "根据芦岑的种子，先用离线处理", "नमस्ते 👩‍💻 ①²Ⅷ", "\x00\x1c\x1d a\x85b", "a" * 3000, "ก็ค่า สวัสดี", "don't WE'LL 3.14e5 ____"])
def test_tokens(machine, reference, text):
    ids = machine.encode(text, bpe.splitter())
    assert ids == reference(text) and machine.decode(ids) == text


@needs_vocab
@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_tokens_random(machine, reference, text):
    ids = machine.encode(text, bpe.splitter())
    assert ids == reference(text) and machine.decode(ids) == text
    assert bpe.splitter()(text) == regex.compile(bpe.PATTERN).findall(text)


@needs_vocab
def test_token_table(spark, reference):
    df = spark.createDataFrame([(1, "ab cd", "en"), (2, None, None), (3, "", "en"), (1, "ab cd", "en"), (None, "x", "zh")], "doc_id long, text string, lang string").withColumn("ids", F.lit(0))
    got = sorted(((r.doc_id, list(r.ids)) for r in bpe.token_ids(df, VOCAB).collect()), key=str)
    assert got == sorted([(1, reference("ab cd")), (1, reference("ab cd")), (2, []), (3, []), (None, reference("x"))], key=str)
    assert bpe.token_ids(df.limit(0), VOCAB).count() == 0
    rep = {r.lang: (r.texts, r.unequal) for r in bpe.token_report(df, VOCAB).collect()}
    assert rep == {"en": (3, 0), None: (1, 0), "zh": (1, 0)}


def test_small_automaton():
    labels = [bytes([c]) for c in b"abc"] + [b"ab", b"bc", b"abc", b"aa"]
    merges = [(0, 1), (1, 2), (3, 2), (0, 0)]
    m = bpe.Transducer(bpe.MergeAutomaton(labels, merges))

    def slow(word):
        ids = [labels.index(bytes([c])) for c in word.encode()]
        for u, v in merges:
            t, i = labels.index(labels[u] + labels[v]), 0
            while i + 1 < len(ids):
                if (ids[i], ids[i + 1]) == (u, v):
                    ids[i : i + 2] = [t]
                i += 1
        return ids
    rng = random.Random(0)
    for _ in range(400):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
        assert list(m.word(w)) == slow(w), w


# leaks


def test_leaks(spark):
    item = " ".join(f"word{i}" for i in range(20))
    zh = "".join(chr(0x4E00 + 3 * i) for i in range(40))
    items = [(1, "en", item), (2, "zh", zh), (3, "en", "too short"), (4, "en", None), (5, "fr", item), (6, "EN", item)]
    part = " ".join(f"WORD{i}" for i in range(4, 16))
    docs = [(1, f"see {part}, end"), (2, " ".join(f"word{i}" for i in range(11))), (3, f"x{zh[5:30]}y"), (4, f"x{zh[5:29]}y"), (5, None), (6, ""), (7, item + " " + item), (None, item), (8, "pad " * 50_000 + part)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(9))
    i = spark.createDataFrame(items, "item_id long, lang string, text string")
    for size in (4_000_000, 50):
        got = {(r.doc_id, r.item_id) for r in leak.leaked_pairs(d, i, shard_chars=size).collect()}
        assert got == {(1, 1), (3, 2), (7, 1), (8, 1), (1, 6), (7, 6), (8, 6)}
    longest = {r.item_id: (r.documents, r.longest) for r in leak.leaked_items(d, i).collect()}
    assert longest == {1: (3, 20), 2: (1, 25), 6: (3, 20)}
    assert sorted((r.doc_id or 0) for r in leak.without_leaks(d, i).collect()) == [0, 2, 4, 5, 6]
    assert leak.leaked_pairs(d.limit(0), i).count() == 0 and leak.leaked_pairs(d, i.limit(0)).count() == 0


@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=40).map(" ".join), max_size=4), st.lists(st.lists(st.sampled_from("abc"), max_size=20).map(" ".join), min_size=1, max_size=3))
@settings(max_examples=60, deadline=None)
def test_leaks_brute_force(docs, items):
    unit, least = leak.UNITS["en"][0], 4
    index = leak.ItemIndex(list(enumerate(items)), unit, least)
    got = {(t, i) for t, i, *_ in leak.shard_matches(index, docs)}
    runs = lambda s: {tuple(s.split()[j : j + least]) for j in range(len(s.split()) - least + 1)}
    assert got == {(t, i) for t, d in enumerate(docs) for i, x in enumerate(items) if runs(d) & runs(x)}


# sentences


def cut(text):
    return [text[a:b] for a, b in sentence_spans(text)]


@pytest.mark.parametrize("units", [
    ["Mr. Dezior vs. Ms. Quaesh was first, 68 to 92.", "n.b. this sorts before that (cf. trecev.txt)."], ['He asked, "Is it safe?" and left.', '"Does it overflow?" asked Plaesh.'], ['Taegex replied: "It does. Try hashing!"', "iMax and eLow were kept at 5 p.m. on day 34."],
    ["The run started at 9 a.m.", "m is at most 13 here."], ["It needs O(n^2) time... and 57.92 MB.", "The queue waits 25 rounds...", "(Test 58 of the suite is wrong.)", "What broke the build?!"], ["See Fig. 53 of the note, i.e. the table.", "Our sample holds dials, etc.", "Sec. 5 shows that X et al. copy it."],
    ["The set {a, b, ...} of L. Trund has 7 members.", "Since v5.8.14 the flag is off; \"on\" means a test.", "An archived copy lives at judge.example/p/5.html and helps."],
    ["Am 3. Tag zählt Stoum alle Werte.", "Die Lösung von Dr. Jeirk braucht ca. 75.9 s, z. B. im Fall 10.", "„Das ist falsch. Nimm a.in!“, schrieb Travrosh.", "Warum endet Test Nr. 12?"], ["La Dra. Vound prueba un árbol, p. ej. en el caso 19.", "«No compila. Revisa a.py», dijo X.", "¡b falla en la prueba n.º 58!", "¿Por qué?"],
    ["«Тест 18 сломан!» — написал Trawaelt.", "См. рис. 46, где x падает до 68.96 и т. д.", "Решение строит дерево, т. е. хватает 5 с."], ["डॉ. Stiomish के अनुसार सीमा 57 है।", "\"फ़ाइल a.cpp गलत है।\" Voziom ने लिखा।", "क्या यह सही है?"],
    ["قال X: \"الملف a.txt خاطئ. أعد المحاولة.\"", "ينص القيد في ص. 8 على أن y لا يتجاوز 6.", "لماذا يفشل الاختبار؟"], ["\"a.py 파일이 틀렸다. 다시 보자.\" Tioclult가 말했다.", "왜 9번 값이 틀릴까?", "b 상한은 7.5배 크다!"],
])
def test_spaced_sentences(units):
    for sep in (" ", "\n", "  "):
        assert cut(sep.join(units)) == units


def test_capitals():
    units = ["DR. MEIGRIV OBJECTED THAT A TABLE BREAKS WHEN N EQUALS 2538.", "THE BOUND IS APPROX. 61.57 TIMES TIGHTER.", '"DOES IT EVER OVERFLOW?" ASKED STOUN.', "SEC. 5 SHOWS THAT X ET AL. COPY IT.", "IT NEEDS O(N) TIME... AND 5 MB.", "IT RAN AT 5 P.M. ON DAY 19.", "OUR SAMPLE HOLDS DIALS, ETC.", "THE RUN STARTED AT 2 A.M.", "Given the order of beads, decide.", "BY T. TRUND, E.G. OVER THE BRIDGES."]
    assert cut(" ".join(units)) == units


def test_unspaced_sentences():
    zh = ["“川棠会溢出吗？”出题人问道，其实够了。", "先做滑动窗口……再把结果输出！", "（沃砚的第38组齿轮重复。）", "岑舟写道：“第30组错了。请看r.py。”然后离开了。", "为什么？"]
    ja = ["「aは66.5倍速い。」とStendは書いた。", "解法は9.9秒で終わる！", "なぜb.pyは止まるのか？"]
    assert cut("".join(zh)) == zh and cut("".join(ja)) == ja


def test_thai():
    assert cut("วิธีของ Viobrund ใช้เวลา 71.58 วินาทีต่อรอบ คำตอบคือค่า 9 หน่วย\nทำไม x จึงช้า") == ["วิธีของ Viobrund ใช้เวลา 71.58 วินาทีต่อรอบ", "คำตอบคือค่า 9 หน่วย", "ทำไม x จึงช้า"]


def test_layout():
    text = "# Head. One\r\nText one\r\ngoes on. Next\n \n- a. b\n- c\nafter\n```py\nx. y\n\nz\n```\ntail"
    assert cut(text) == ["# Head. One", "Text one\r\ngoes on.", "Next", "- a. b", "- c", "after", "```py\nx. y\n\nz\n```", "tail"]
    assert cut(None) == cut("") == cut(" \n　") == []


@given(st.text(alphabet="aB .!?\"“”()\n。」#-`ก…\r\xa0", max_size=80))
@settings(max_examples=300, deadline=None)
def test_sentences_cover(text):
    at = 0
    for a, b in sentence_spans(text):
        assert a >= at and not text[at:a].strip() and a < b and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, " "), (1, "A b. C d."), (4, "long. " * 20_000)], "doc_id long, text string").withColumn("start_pos", F.lit(1))
    got = Counter(tuple(r) for r in sentences(df).where("doc_id = 1").collect())
    assert got == {(1, 0, 4): 2, (1, 5, 9): 2} and sentences(df).where("doc_id = 4").count() == 20_000 and sentences(df.limit(0)).count() == 0
