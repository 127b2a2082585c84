"""Controlled vocabulary of product descriptions.

Fixed values: these words, labels and patterns decide which products count as equal,
so they must stay as they are.
"""

WORD_TO_FORM = {
    "TAB": "Tableta", "TABLETA": "Tableta", "TABLETAS": "Tableta",
    "COMPRIMIDO": "Tableta", "COMPRIMIDOS": "Tableta",
    "CAP": "Cápsula", "CAPS": "Cápsula", "CAPSULA": "Cápsula", "CAPSULAS": "Cápsula",
    "JBE": "Jarabe", "JARABE": "Jarabe",
    "SUSP": "Suspensión", "SUSPENSION": "Suspensión",
    "SOL": "Solución", "SOLUCION": "Solución",
    "CREMA": "Crema", "CREM": "Crema", "GEL": "Gel",
    "UNG": "Ungüento", "UNGUENTO": "Ungüento", "POMADA": "Ungüento",
    "AMPOLLA": "Inyectable", "AMP": "Inyectable", "INY": "Inyectable", "INYECTABLE": "Inyectable",
    "GOTAS": "Solución", "COLIRIO": "Solución",
    "GRAGEA": "Tableta", "GRAGEAS": "Tableta",
    "SUPOS": "Supositorio", "SUPOSITORIO": "Supositorio", "SUPOSITORIOS": "Supositorio",
    "OVULO": "Óvulo", "OVULOS": "Óvulo", "OVUL": "Óvulo",
    "SHAMP": "Shampoo", "SHAMPOO": "Shampoo",
    "INHALADOR": "Aerosol inhalador",
    "IMPLANTE": "Implante", "IMPLANTES": "Implante",
    "JALEA": "Jalea", "ESPUMA": "Espuma",
}

# Looked up in this order, before single words.
PHRASE_TO_FORM = (
    ("SOLUCION INYECTABLE", "Inyectable"),
    ("SUSPENSION INYECTABLE", "Inyectable"),
    ("SOL INY", "Inyectable"),
    ("SUSP INY", "Inyectable"),
    ("CREMA VAGINAL", "Crema vaginal"),
    ("CREM VAG", "Crema vaginal"),
    ("AEROSOL INH BUC", "Aerosol inhalador"),
    ("AEROSOL INH NAS", "Aerosol nasal"),
    ("AEROSOL TOP", "Aerosol"),
    ("POL INH BUC", "Polvo inhalado"),
    ("SOL INH BUC", "Solución inhalada"),
    ("POLVO PARA INHALACION", "Polvo inhalado"),
    ("POL INH", "Polvo inhalado"),
    ("SUSP INH BUC", "Suspensión inhalada"),
    ("SOL INH NAS", "Solución nasal"),
    ("SOL INH", "Solución inhalada"),
    ("INH BUC", "Aerosol inhalador"),
    ("SOLUCION PARA INHALACION NASAL", "Solución nasal"),
    ("SOLUCION PARA INHALACION", "Solución inhalada"),
    ("SUSPENSION PARA INHALACION", "Suspensión inhalada"),
    ("SOLUCION INHALACION", "Solución inhalada"),
    ("SUSPENSION INHALACION", "Suspensión inhalada"),
    ("SUSP NAS", "Suspensión nasal"),
    ("SUSPENSION NASAL", "Suspensión nasal"),
    ("EMULSION TOPICA - SHAMPOO", "Shampoo"),
    ("EMULSION TOPICA", "Emulsión"),
    ("EMUL TOP", "Emulsión"),
    ("EMULSION OFTALMICA", "Emulsión oftálmica"),
    ("EMUL OFT", "Emulsión oftálmica"),
    ("LOCION TOPICA", "Loción"),
    ("LOC TOP", "Loción"),
    ("LOCION CAPILAR", "Loción"),
    ("POMADA TOPICA", "Ungüento"),
    ("PARCHE TRANSDERMICO", "Parche transdérmico"),
    ("SIST TRANSD", "Parche transdérmico"),
    ("OVULO VAGINAL", "Óvulo"),
    ("OVUL VAG", "Óvulo"),
    ("SUPOSITORIO RECTAL", "Supositorio"),
    ("POL GRAN PRO", "Polvo"),
    ("POL GRAN", "Polvo"),
    ("POL ORL", "Polvo"),
)

WORD_TO_PACKAGING = {
    "CAJA": "Caja", "CAJAS": "Caja",
    "FRASCO": "Frasco", "FRASCOS": "Frasco", "FCO": "Frasco", "FCOS": "Frasco",
    "BLISTER": "Blíster", "BLISTERES": "Blíster",
    "SOBRE": "Sobre", "SOBRES": "Sobre",
    "TUBO": "Tubo", "TUBOS": "Tubo",
    "POTE": "Pote", "POTES": "Pote",
    "TARRO": "Frasco", "TARROS": "Frasco",
}

FORM_TO_UNIT = {
    "Tableta": "tabletas", "Cápsula": "cápsulas",
    "Jarabe": "ml", "Suspensión": "ml", "Solución": "ml",
    "Crema": "g", "Crema vaginal": "g", "Gel": "g", "Ungüento": "g",
    "Ampolla": "ampollas", "Inyectable": "ampollas",
    "Supositorio": "supositorios", "Óvulo": "óvulos", "Shampoo": "ml",
    "Emulsión": "ml", "Emulsión oftálmica": "ml", "Loción": "ml",
    "Aerosol inhalador": "dosis", "Aerosol nasal": "dosis", "Aerosol": "dosis",
    "Polvo inhalado": "dosis", "Solución inhalada": "dosis", "Solución nasal": "dosis",
    "Suspensión inhalada": "dosis", "Suspensión nasal": "dosis",
    "Parche transdérmico": "parches",
}

UNKNOWN_FORM = "No especificada"
SEALED_FORMS = ("Inyectable", "Ampolla")
MEASURE_UNITS = ("ml", "g")
PERCENT_FORMS = ("Solución", "Gotas", "Suspensión", "Jarabe", "Inyectable", "Ampolla")
SECTORS = ("MEDICAMENTOS", "DISPOSITIVOS_MEDICOS", "ODONTOLOGIA", "ASEO", "PAPELERIA")

# Patterns of a description (upper case, no accents).
NUM = r"\d+(?:[.,]\d+)?"
CHANNEL_PREFIX = r"^(?:EPS|POS|NO[\s-]?POS|PBS)[\s-]+"
WITHOUT_EPINEPHRINE = r"\s*(?:SIN\s+EPINEFRINA|S/\s*EPINEFRINA)\b"
SALT_WORDS = r"\b(?:SODICA|SODICO|POTASICA|POTASICO|CALCICA|CALCICO|MAGNESICA|MAGNESICO)\b"
PREFILLED_SYRINGE = r"JER(?:INGA)?\s*PRE(?:LLENADA)?"
SINGLE_CONTAINER = r"[X*]\s*(VIAL|AMPOLLA|AMPOLLAS|JERINGA|FRASCO|TUBO|SOBRE)\b"

# Column headers a price list may use, by target (first match in this order).
HEADER_ALIASES = {
    "supplierProductCode": ("codigo", "sku", "referencia", "ref", "cod"),
    "productName": ("descripcion", "producto", "descripcion comercial", "nombre", "articulo"),
    "presentation": ("presentacion", "empaque"),
    "dosageForm": ("forma farmaceutica", "forma"),
    "laboratory": ("laboratorio", "lab", "marca", "fabricante"),
    "price": ("precio x presentacion", "precio", "valor", "vlr", "vr"),
    "tax": ("iva", "impuesto"),
    "availability": ("disponible", "disponibilidad", "existencia", "stock", "cantidad disponible"),
    "stock": ("stock", "existencia", "cantidad"),
    "expirationDate": ("fecha vencimiento", "fec_venc", "vencimiento", "fecha vence", "caducidad"),
}

CLIENT_HEADERS = (
    "cliente", "clientes", "eps", "entidad", "paciente", "institucion", "institución", "afiliado", "cuenta",
)

# Suppliers with a known layout: (key, name pattern, exclude zero stock, price per unit, {target: header}).
SUPPLIER_LAYOUTS = (
    (
        "disfarma", "disfarma", False, True,
        {
            "supplierProductCode": "CODIGO", "productName": "DESCRIPCION", "price": "Ger_EPS_UND",
            "dosageForm": "FORMA_FARMACEUTICA", "presentation": "PRESENTACION",
            "laboratory": "LABORATORIO", "expirationDate": "FEC_VENC",
        },
    ),
    (
        "ramedicas", "ramedicas", True, True,
        {
            "supplierProductCode": "CODIGO INTERNO MEDICAMENTO",
            "productName": "DESCRIPCION COMPLETA DEL PRODUCTO", "presentation": "PRESENTACION",
            "price": "PRECIO X UD", "laboratory": "LABORATORIO", "stock": "STOCK ACTUAL",
        },
    ),
    (
        "offimedicas", "of+imedicas", True, True,
        {
            "supplierProductCode": "ID_PRODUCTO", "productName": "PRODUCTO", "laboratory": "LABORATORIO",
            "stock": "CANTIDAD", "price": "PRECIO UND",
        },
    ),
)
EXPIRY_REPORTING_LAYOUT = "disfarma"
