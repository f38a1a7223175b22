"""Small literal inputs of our own that show the document operators at work; shared by queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CAPTION_A = "PÉREz, JUAn c/ ESTADo NACIONAl s/ daños"
CAPTION_B = "TRANSPORTEs del SUr S.A. c/ GÓMEz, ANa s/ cobro de pesos"

#: (tomo, pdf_page, texto)
PAGES = (
    (400, 1, "DE JUSTICIA DE LA NACIÓN 1\n400\n" + CAPTION_A + "\nRESPONSABILIDAD DEL ESTADO\nEl Estado responde por los daños. (Voto del juez Rosa Luna)\nFALLO DE LA CORTE SUPREMA\nBuenos Aires, 6 de febrero de 2031.\nConside-\nrando: que el recurso es formalmente pro-\ncedente, como surge de Fallos: 311:2478; 312:45 y 99."),
    (400, 2, "2 FALLOS DE LA CORTE SUPREMA\n400\nSe confirma la sentencia. Notifíquese y devuélvase.\nRosa Luna — Pedro Sol (según su voto) — Ana Mar.\nRecurso extraordinario interpuesto por Juan Pérez.\nTribunal de origen: Cámara Federal de\nMendoza. Sala A.\nVoto del señor ministro doctor don Pedro Sol\nConsiderando:\nQue adhiero al voto que antecede."),
    (400, 3, "DE JUSTICIA DE LA NACIÓN 3\n400\nTexto final del primer fallo.\n" + CAPTION_B + "\nDictamen de la Procuración General\nOpino que corresponde rechazar la queja.\nFALLO DE LA CORTE SUPREMA\nBuenos Aires, 10 de setiembre de 2031.\nSe rechaza. Ver Fallos: 400:2.\nArchívese.\nRosa Luna.\n(*) Sentencia del 7 de febrero de 2031. Ver fallo."),
    (400, 4, "ÍNDICE POR LOS NOMBRES DE LAS PARTES\nlista"),
)
#: (tomo, pdf_page, columna, lineas)
INDEX = (
    (400, 4, 0, ["NOMBRES DE LAS PARTES", "P", "Pérez, Juan c/ Estado Nacional", "s/ daños: p. 1", ""]),
    (400, 4, 1, ["T", "Transportes del Sur S.A. c/ Gómez,", "Ana s/ cobro de pesos: p.", "3"]),
)
CITATIONS = (
    ("a", "Ver Fallos: 311:2478 y 312:45; 99 y otros."),
    ("b", "Conf. Fallos:\n300:10, 12, esp. p. 15 y 301:20; asimismo Fallos: 401:5 y Fallos : 20:7."),
    ("c", "Sin citas; Fallos 311:5 no tiene ancla."),
    ("d", "fallos: 320:1, 321:9000; 322:1"),
)
PARTIES = (
    "Estado Nacional", "E.N. - Ministerio de Defensa", "Provincia de Salta", "Mendoza, Provincia de", "Municipalidad de Rosario", "A.F.I.P.", "Banco Central de la República Argentina",
    "Banco de la Nación Argentina", "Universidad Nacional de Cuyo", "Obra Social de Choferes", "Transportes del Sur S.A.", "Aceros SRL", "Banco Río", "Cooperativa Obrera", "Pérez, Juan", "N.N.",
    "Sucesión de Ana Díaz", "García, José y otros", "YPF", "Asociación de Vecinos del Barrio Norte", "", "Roca",
)
SNIPPETS = (
    (1, "Texto corto sobre daños."),
    (2, "Primera frase que no interesa para nada a nadie en este lugar. " * 4 + "Aquí se trata de la responsabilidad del Estado por los daños que causa. " + "Sigue mucho texto que tampoco interesa a nadie. " * 6),
    (3, "palabra " * 60),
)
ABSTRACTS = (
    ('{"tomo":"400","pagina":"1","autos":"Pérez c/ Estado","fechaString":"6/2/2031","voces":"DAÑOS - ESTADO -  - CULPA","texto":"<p>El&nbsp;Estado <b>responde</b></p>","linkDocumento":"ver.html?idDocumento=77&x=1","analisisDocumental":{"materiaSecretaria":"CIVIL"}}', 400, 1),
    ('{"caratulaWeb":"Otra","fechaString":"mal","voces":null,"analisisDocumental":{"materiaSecretaria":{"descripcion":" PENAL "}}}', 400, 3),
)
CATALOG = """<div class="lg-col-span-4 x"><span> 347-I </span></div><div class="lg-col-span-3"><span>2024</span></div><a href="/sj/verTomo?tomoId=11">v</a>
<div class="lg-col-span-4 x"><span>347-II</span></div><div class="lg-col-span-3"><span>2024</span></div><a href="/sj/verTomo?tomoId=12">v</a>
<div class="lg-col-span-4 x"><span>21</span></div><div class="lg-col-span-3"><span>1879/1880</span></div><a href="/sj/verTomo?tomoId=3">v</a>
P&aacute;gina&nbsp;<span>1</span> de <span>5</span>"""


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PAGES), "tomo int, pdf_page int, texto string")


def index_columns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(INDEX), "tomo int, pdf_page int, columna int, lineas array<string>")
