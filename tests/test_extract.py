"""Golden descriptions: (text, presentation required) -> expected fields, or None."""

from pyspark.sql import functions as F

from procura.operators.extract import add_dosage_form, add_ingredient_guess, extract_attributes

A, C, U, FORM, Q, QU, KEY = (
    "active_ingredient", "concentration", "concentration_unit", "dosage_form", "presentation_quantity",
    "presentation_unit", "generic_key",
)
GOLDEN = [
    ("ACETAMINOFEN TAB 500MG X100", True, {A: "ACETAMINOFEN", C: "500", U: "MG", FORM: "Tableta", Q: 100}),
    ("PARACETAMOL 500 MG TABLETAS CAJA X 100", True, {"presentation_type": "Caja", Q: 100}),
    ("AMOXICILINA + CLAVULANATO 500/125 MG X21", True, {C: "500/125", Q: 21}),
    ("LOSARTAN 50MG SOLUCION ORAL FRASCO X 1.5L", True, {Q: 1500, QU: "ml"}),
    ("RISPERIDONA 1MG/ML (0,1%) SOLUCION ORAL CAJA CON FRASCO X 30ML", True, {Q: 30, QU: "ml"}),
    ("APME EN POLVO FORMULA POLIMERICA PARA NINOS LATA X 400G", False, {Q: 400, QU: "g"}),
    ("Poliestireno Sulfonato Calcico 99 % polvo para reconstituir solucion o suspension oral Tarro 400 g x 1", True, {Q: 400, QU: "g"}),
    ("Ampicilina 1 g inyectable amp 1 g x 10 FARMALOGICA 20102511-01", True, {Q: 10, QU: "ampollas"}),
    ("TOXINA BOTULINICA TIPO A 100UI POLVO A SOLUCION INYECTABLE CAJA X VIAL", True, {Q: 1}),
    ("EPS-ZOPICLONA 7.5MG C*30 TAB - RECIPE", True, {A: "ZOPICLONA", KEY: "zopiclona 7.5 mg tableta"}),
    ("ABACAVIR 600MG FCO*30 TAB", True, {Q: 30}),
    ("ABACAVIR 20MG/ML SOL ORL C*1 FCO X 240ML", True, {Q: 240, QU: "ml"}),
    ("PRODUCTO 100MG CAJA*VIAL", True, {Q: 1}),
    ("ABACAVIR 300MG C*1 FCO X 60 TAB", True, {Q: 60}),
    ("LECTOR FRESTYLE LIBRE 2 UNIDAD", True, None),
    ("PRODUCTO SIN DATOS CLAROS", True, None),
    ("AMOXICILINA 500/125 X21", True, None),
    ("ACIDO VALPROICO 250MG CAPSULA", False, {A: "ACIDO VALPROICO", C: "250", FORM: "Cápsula", Q: 1}),
    ("ACIDO VALPROICO 250MG CAPSULA", True, None),
    ("Esomeprazol x 40 mg", False, {A: "ESOMEPRAZOL", C: "40", U: "MG", Q: 1}),
    ("Hidróxido de aluminio + simeticona suspensión x 360 ml", False, None),
    ("Carboximetilcelulosa gotas al 0.5%", False, {A: "CARBOXIMETILCELULOSA", C: "0.5", U: "%", FORM: "Solución"}),
    ("MAGNESIO SULFATO 2G/10ML (0,2G/ML) (20%) SOLUCION INYECTABLE CAJA X10", True, {C: "20", U: "%"}),
    ("EPS-SULFATO MAGNESIO 20% SOL INY AMPX10ML CX40 - ROPSOHN", True, {C: "20", U: "%"}),
    ("NITROFURAZONA 0,2G/100G (0,2%) POMADA TOPICA CAJA X40", True, {C: "0.2", U: "%"}),
    ("NITROFURAZONA POMADA  0.2 %/40 G", False, {C: "0.2", U: "%"}),
    ("MEDICAMENTOTEST 50MG/5ML SUSPENSION ORAL", False, {C: "10", U: "MG/ML", KEY: "medicamentotest 10 mg/ml suspension"}),
    ("MEDICAMENTOTEST 10MG/1ML SUSPENSION ORAL", False, {KEY: "medicamentotest 10 mg/ml suspension"}),
    ("MEDICAMENTOTEST 10MG/ML SUSPENSION ORAL", False, {KEY: "medicamentotest 10 mg/ml suspension"}),
    ("ACETAMINOFEN 1.000MG TABLETA", False, {C: "1000", U: "MG"}),
    ("ESTROGENOS CONJUGADOS 0.625MG/G CREMA VAGINAL X43G", True, {C: "0.625"}),
    ("ACETAMINOFEN (PARACETAMOL) 10MG/ML (1%) SOLUCION INYECTABLE", False, {A: "ACETAMINOFEN"}),
    ("CEFAZOLINA 1GR C*10AMP", False, {C: "1", U: "G"}),
    ("CLORURO DE POTASIO 2MEQ/ML SOL INY AMPOULEPACKX10ML CX40", False, {C: "2", U: "MEQ"}),
    ("ENOXAPARINA 40MG/0.4ML SOLUCION INYECTABLE", False, {C: "40/0.4", U: "MG/ML"}),
    ("BACLOFENO 10MG/20ML (0,5MG/ML) SOLUCION INYECTABLE", False, {C: "10/20"}),
    ("HIOSCINA N-BUTIL BROMURO 20MG/1ML SOLUCION INYECTABLE", False, {C: "20", U: "MG"}),
    ("Bupivacaina sin epinefrina 0.5 % solucion inyectable amp 10 mL x 100 BIOSANO", False, {KEY: "bupivacaina 0.5 % inyectable"}),
    ("BUPIVACAINA S/EPINEFRINA 50MG/10ML (5MG/ML) (0,5%) SOLUCION INYECTABLE", False, {KEY: "bupivacaina 0.5 % inyectable"}),
    ("Bupivacaina Con Epinefrina 0.5 % solucion inyectable amp 10 mL x 24 ROPSOHN", False, {A: "BUPIVACAINA CON EPINEFRINA"}),
    ("AMPICILINA SODICA + SULBACTAM SODICO POLVO PARA RECONSTITUIR 1.5G VIAL", False, {A: "AMPICILINA + SULBACTAM", FORM: "Inyectable"}),
    ("DICLOFENACO SODICO 50MG TABLETA", False, {A: "DICLOFENACO"}),
    ("METOPROLOL TARTRATO 100MG TABLETA", False, {A: "METOPROLOL TARTRATO"}),
    ("GOSERELINA 3,6MG IMPLANTE SUBCUTANEO", False, {FORM: "Implante", C: "3.6"}),
    ("Ampicilina 1 g + Sulbactam 0.5 g inyectable amp 1.5 g x 10 ampidelt DELTA 20036512-02", False, {A: "AMPICILINA + SULBACTAM", C: "1/0.5"}),
    ("AMPICILINA + SULBACTAM 1G+0,5G POLVO A SOLUCION INYECTABLE", False, {C: "1/0.5", KEY: "ampicilina sulbactam 1/0.5 g inyectable"}),
    ("Acido Ascorbico 100 mg + Acido Folico 2 mg + fumarato ferroso 330 mg + Vitamina B12 1 mg capsula dura Caja x 30", False, {A: "ACIDO ASCORBICO", C: "100"}),
    ("EPS-PALIPERIDONA 350MG/1.750ML SUSP INY JERPREX1.750ML CX1 (INVEGA TRINZA 546MG - 3 MESES) - JANSSEN", False, {C: "350/1.75", Q: 2}),
    ("SODIO CLORURO (0,9%) SOLUCION INYECTABLE X 1.000ML", False, {Q: 1000}),
    ("HIDROXIDO DE ALUMINIO/HIDROXIDO DE MAGNESIO/SIMETICONA SUSPENSION ORAL 4+4+0.4 G/100ML", False, {C: "4/4/0.4", U: "G"}),
    ("IPRATROPIO BROMURO/FENOTEROL SOLUCION PARA INHALACION 0.25+0.5 MG/ML/20 ML", False, {C: "0.25/0.5", U: "MG"}),
    ("PIPERACILINA/TAZOBACTAM POLVO PARA RECONSTITUIR 4.5 G VIAL", False, {A: "PIPERACILINA + TAZOBACTAM"}),
    ("LIDOCAINA C/EPINEFRINA (2%) SOLUCION INYECTABLE", False, {A: "LIDOCAINA C/EPINEFRINA"}),
    ("POTASIO CLORURO 20 MQ /10 ML SOLUCION INYECTABLE", False, {C: "20/10", U: "MEQ/ML"}),
    ("VASELINA POTE * 500GR", False, {A: "VASELINA"}),
    ("HIDROXIDO ALUMINIO + MAGNESIO + SIMETICONA SUSP FCO 360 ML", False, None),
    ("ENOXAPARINA AMPOLLA 60/0.6 AMPOLLAS", False, {C: "60/0.6", U: "MG/ML"}),
    ("DIPIRONA SODICA+N-BUTILBROMURO DE HIOSCINA (2.5G+20MG)/5ML SOL INY AMPX5ML", False, {C: "2.5/0.02", U: "G"}),
    ("IPRATROPIO BROMURO SOLUCION INHALACION 20MCG", False, {FORM: "Solución inhalada"}),
    ("HIDROCORTISONA+LIDOCAINA 5MG+60MG C*10 SUPOS", True, {C: "5/60", KEY: "hidrocortisona lidocaina 5/60 mg supositorio"}),
    ("LIDOCAINA + HIDROCORTISONA 60MG+5MG SUPOSITORIO RECTAL CAJA X 10", True, {KEY: "hidrocortisona lidocaina 5/60 mg supositorio"}),
    ("ALUMINIO HIDROXIDO+MAGNESIO+SIMETICONA 4G+4G X150ML", True, {C: "4"}),
    ("ALUMINIO HIDROXIDO + MAGNESIO + SIMETICONA 4G X150ML", True, {KEY: "aluminio hidroxido magnesio simeticona 4 g no especificada"}),
]


def test_golden_descriptions(spark):
    df = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(GOLDEN)], "i int, t string, req boolean")
    got = {r["i"]: r["attrs"] for r in extract_attributes(df, "t", F.col("req")).select("i", "attrs").collect()}
    wrong = []
    for i, (text, _, expected) in enumerate(GOLDEN):
        found = got[i].asDict() if got[i] is not None else None
        if expected is None or found is None:
            if (expected is None) != (found is None):
                wrong.append((text, expected, found))
        elif any(found[k] != v for k, v in expected.items()):
            wrong.append((text, expected, {k: found[k] for k in expected}))
    assert not wrong


def test_name_guess_and_form(spark):
    texts = ["Beclometasona inhalador", "Polietilenglicol sobres", "Amoxicilina 500 suspension", "Vaselina pote x 500 g", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["g"] for r in add_ingredient_guess(rows, "t", "g").orderBy("i").collect()]
    assert got == ["BECLOMETASONA", "POLIETILENGLICOL", None, "VASELINA", None]
    forms = spark.createDataFrame([(0, "TABLETA RECUBIERTA"), (1, "dispositivo"), (2, "Solución inyectable")], "i int, t string")
    assert [r["f"] for r in add_dosage_form(forms, "t", "f").orderBy("i").collect()] == ["Tableta", None, "Inyectable"]
