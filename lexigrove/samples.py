"""Small own texts and tables with what the driver's tables lack: contents pages, numbered clauses, formulas, other scripts.

Queries add them to the driver's rows (with negative ids), so that both outcomes of a test occur; tests use them too.
"""

TEXTS = [
    (-1, "Contents\n1 Scope ........ 3\n2 Terms ........ 5\n3 Loads ........ 9\n4 Tests ........ 14\n5 Annex …… 20\nend of list"),
    (-2, "1 Scope\nThis part applies to light gear.\n1.1 General\nThe gear is tested, see 4.2.1.\n2.\nLoads of the frame\n12\nстраница 3 из 9\n4-7\n2020 results were good"),
    (-3, "The sys-\ntem of con-\n  trol­led valves works \t well   \nnext  line "),
    (-4, "Раздел 3 Нагрузки\nНагрузки на раму указаны в таблице. Проверка выполняется по методике завода.\n3.1 Общие\nТекст пункта."),
    (-5, "x = 12 + 3*4 - 5\ny = (a + b)/(c - d) = 17.5\nz^2 + w_1 >= 4/3"),
    (-6, "<descript><entry id='4'>42</entry></descript>"),
    (-7, "https://example.com/a/b/c see there"),
    (-8, "12345 67890 12345 67890 12345"),
    (-9, "a\nb\nc\nd\ne"),
    (-10, "Смешанный text of two languages, наполовину русский and half of it English"),
    (-11, "σ = μ + λ and β of the gear"),
    (-12, "\x01control � and brok-\nen words"),
    (-13, "References\n1. Smith A. Loads. 1987. pp. 3 // Journal 4"),
    (-14, "xqzt bcdfghk aaaab mil-std-810 ISO9001 descrWire word12345x a~b 12.5mm"),
    (-15, "_____\n= = =\n(9.78)\nM =\nf. g.\nwhere the load\nη = P/Q"),
    (-16, ""),
    (-17, "7 lowercase title\n8 Four\n401 Too large a number\n05 Leading zero\n6.2\n1.23456\nп. 9 Short\nchapter 4 Title here\n3 Terms .... 8\n10 2020"),
    (-18, "Ticks 0 -8 -12 and 88 89 90\nα/β + γ = 2·δ"),
]
