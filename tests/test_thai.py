"""Syllables against a hand count."""

import random
import time

from pyspark.sql import functions as F

from loomwright.functions import prosody, thai

#: Counted by hand: clusters, led consonants, silent marks, leading and unwritten vowels, linking syllables, lines.
COUNTED = {
    1: "ปลา คน ต้น น้ำ ก็ ณ บ่ เกาะ เพราะ เดือน เสียง เมือง เธอ เกิด เงิน เลย เปล่า เพลง เลข เมฆ เร็ว เหล้า เหนือ เหมือน แก้ว แล้ว แพะ โต๊ะ และ ไหม ไหล ไกล ใคร ใหญ่ ไมล์ ไวน์ เสาร์ จันทร์ ศาสตร์ ไทย ธรรม พรรค สร้าง เศร้า เสร็จ จริง ทราบ ทราย หมา อยู่ อย่าง อยาก สวย ควาย กวน ขวบ สวน ช่วย ด้วย กล้วย ผู้ ผัว กลัว รวย ข้าว เขียว เลี้ยว ชาติ เหตุ ฟรี พระ ตรง ขวัญ กลม กลอน จักร มิตร บัตร เสื้อ เรื่อย เยอะ สิทธิ์ พันธุ์ ล็อก เล่น พร ดื่ม มือ คือ ครับ ค่ะ นะ เกม เบรก พุทธ ฝั่ง ผึ้ง เด็ก แข็ง เห็ด เท้า เข่า เสือ เรือ เบื่อ เปียก",
    2: "สนุก ตลาด ขนม ถนน สบาย อร่อย ตำรวจ ทหาร โรงเรียน นักเรียน ประเทศ กรุงเทพ สามารถ อาทิตย์ หนังสือ สมุด ตลอด นคร ละคร แสดง เสมอ เฉลี่ย แถลง เสนอ เวลา ราคา ฤดู พฤกษา อังกฤษ เท่านั้น สัปดาห์ โอกาส ขอบคุณ หัวใจ ตัวอย่าง ดวงดาว ดอกไม้ อากาศ อาหาร มากมาย สวรรค์ พลัง กวี เจริญ สมบัติ ภูเขา ทะเล แม่น้ำ ต้นไม้ ความรัก ชีวิต ลำธาร เดินทาง เพื่อนบ้าน สีเขียว ท้องฟ้า ใบไม้ เด็กดี เสมียน เฉพาะ ไสว อนึ่ง กระจก ภูมิใจ วันจันทร์",
    3: "หญ้าเขียวเขียว นกร้องเพลง สวัสดี พยายาม ตลาดน้ำ คอมพิวเตอร์ นาฬิกา อนุญาต ขอบพระคุณ บริษัท บรรยากาศ ประชาชน เศรษฐกิจ ผลไม้ รัฐบาล โทรศัพท์ วิทยา ธรรมชาติ ปริญญา สุขภาพ ทฤษฎี อธิบาย สถานี มะละกอ กะหล่ำปลี เครื่องบินเล็ก ชั่วโมงนี้ อุทยาน โทรทัศน์",
    4: "ขออนุญาต วิทยาศาสตร์ วัฒนธรรม พิพิธภัณฑ์ ฟ้าใสสดใส ลมพัดเบาเบา ประวัติศาสตร์ อุบัติเหตุ ฉันรักเมืองไทย",
    6: "มหาวิทยาลัย ด้วยความเคารพอย่างสูง",
    8: "แล้วสอนว่าอย่าไว้ใจมนุษย์ มันแสนสุดลึกล้ำเหลือกำหนด",
}


def test_hand_count():
    words = [(w, n) for n, line in COUNTED.items() for w in line.split()]
    assert len(words) > 200
    # two lines of a known poem: eight beats, of which one word has a short extra syllable
    wrong = [(w, n, thai.parts(w)) for w, n in words if thai.count_syllables(w) not in ((n, n + 1) if n == 8 else (n,))]
    assert not wrong


def test_other_signs():
    assert thai.count_syllables("") == thai.count_syllables(" .!? 12 漢字") == 0
    assert thai.count_syllables("ปี ๒๕๖๘ hello world") == 4 and thai.count_syllables("ดีๆ") == 2
    assert thai.parts("ะกา") == [("ะ", 0), ("กา", 1)]  # a sign that fits nowhere
    assert "".join(p for p, _ in thai.parts("ฉันรักเมืองไทยะ")) == "ฉันรักเมืองไทยะ"


def test_long_texts_take_linear_time():
    times = []
    for n in (2000, 20000):
        began = time.perf_counter()
        assert thai.count_syllables("ปลาน้ำเกาะ" * n) == 3 * n
        times.append(time.perf_counter() - began)
    assert times[1] < 40 * times[0]


def test_columns(spark):
    df = spark.createDataFrame([("โรงเรียน\nปลา",), (None,), ("",)], "x string")
    got = df.select(prosody.syllable_counter()(F.col("x")), prosody.syllable_parts(F.col("x")), prosody.syllable_counter(len)(F.col("x"))).collect()
    assert [r[0] for r in got] == [3, 0, 0] and [r[2] for r in got] == [12, 0, 0]
    assert got[1][1] is None and [(p["part"], p["n"]) for p in got[0][1]] == [("โรง", 1), ("เรียน", 1), ("ปลา", 1)]


def test_counts_are_those_of_the_parse_and_nothing_of_a_text_is_kept(monkeypatch):
    rng, words = random.Random(3), " ".join(thai.IRREGULAR.values()).split()
    signs = thai.CONSONANTS + thai.TONES + "ะาิีึืุูเแโไใ็์ำัฤๅ"
    for most in (thai.MOST_PLACES, 20):
        monkeypatch.setattr(thai, "MOST_PLACES", most)
        for _ in range(500):
            x = "".join(rng.choice([rng.choice(signs), rng.choice(words), rng.choice(thai.CLUSTERS), rng.choice(thai.FINALS)]) for _ in range(rng.randint(1, 25)))
            assert thai.count_syllables(x) == sum(n for _, n in thai.parts(x)), x
            assert len(thai._PLACES) <= most
    thai._parsed.cache_clear()
    lines = ["".join(rng.choices(words, k=100)) for _ in range(50)]
    assert [thai.count_syllables(x) for x in lines] == [sum(n for _, n in thai.parts(x)) for x in lines]
    assert thai._parsed.cache_info().currsize == 0


def test_lines_of_a_verse_are_computed_once(spark, monkeypatch):
    """However many lines and words: each text is split and each line read once a use, not once a word."""
    import itertools

    rng = random.Random(4)
    text = "\n".join([" " + " ".join(rng.choices(["ปลา", "เดือน", "นา", "ตา"], k=300)) + "\u3000" for _ in range(400)])
    df = spark.createDataFrame([("klon_8_composition", text), ("klon_8_composition", " a \n\t\n\u2003ข")], "t string, x string")
    started = time.time()
    got = [r[0] for r in df.select(prosody.prosody_issues(F.col("t"), F.col("x"))).collect()]
    assert time.time() - started < 20
    w = [line.split() for line in text.split("\n")]
    rhymes = []
    for k in itertools.count():
        if 4 * k >= len(w):
            break
        a, b, c = w[4 * k : 4 * k + 3]
        rhymes += [f"rhyme {k + 1}:1"] * all(x[-2:] != a[-1][-2:] for x in b[1:-1]) + [f"rhyme {k + 1}:2"] * (b[-1][-2:] != c[-1][-2:])
    assert [x for x in got[0] if x.startswith("rhyme")] == rhymes and len(got[0]) == len(rhymes) + 400
    assert got[1] == ["stanza"]
    assert [list(r[0]) for r in df.select(prosody.verse_lines(F.col("x"))).collect()][1] == ["a", "ข"]
