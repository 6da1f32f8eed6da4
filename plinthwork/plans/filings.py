"""Directors of filings that are composed from each supplier's key, in five shapes; the twin knows them from the composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinthwork.functions.storage import table
from plinthwork.operators import filings as fl

GIVEN = "Jane Adam Mary Thomas Grace Peter Olive".split()
FAMILY = "Doe Portnoy Capasse Holmes Stone Rivera Lindqvist Moreau Baker Okafor Tanaka".split()
_NAME = "concat(element_at(array({g}), cast((k + j) % 7 + 1 as int)), ' ', element_at(array('A', 'B', 'C'), cast(k % 3 + 1 as int)), '. ', element_at(array({f}), cast((2 * k + j) % 11 + 1 as int)))".format(g=", ".join(f"'{x}'" for x in GIVEN), f=", ".join(f"'{x}'" for x in FAMILY))
_AGE, _SINCE, _COMMITTEE = "(40 + (k + j) % 40)", "(1990 + (k + 3 * j) % 30)", "if(j % 3 = 0, 'Audit Committee', if(j % 3 = 1, 'Risk and Finance Committees', ''))"
_SHAPES = (
    ("", f"concat('<table><tr><td rowspan=2></td><td></td></tr><tr><td>', {_NAME}, ' age ', {_AGE}, ' director since ', {_SINCE}, if(j % 2 = 0, ' Independent. ', ' '), {_COMMITTEE}, '</td></tr></table>')", ""),
    ("<table><tr><td></td></tr><tr><th>Name</th><th>Age</th><th>Director Since</th><th>Independent</th><th colspan=\"2\">Committees</th></tr>", f"concat('<tr><td>Mr. ', {_NAME}, ' (3)<td>', {_AGE}, '<td>', {_SINCE}, '<td>', if(j % 2 = 0, 'Yes', 'No'), '<td><td>', {_COMMITTEE}, '</tr>')", "</table>"),
    ("<p>These are our directors. ", f"concat({_NAME}, ' (age ', {_AGE}, ') has led many firms for years. Director since ', {_SINCE}, '. ')", "</p>"),
    ("", f"concat('<h3>', {_NAME}, '</h3><div>Age: ', {_AGE}, ' Director Since: May ', {_SINCE}, ' Independent: ', if(j % 2 = 0, 'Yes', 'No'), ' &bull; ', {_COMMITTEE}, ' &bull; and further words to fill up this block</div>')", ""),
    ("<p>There is no list.</p>", "''", ""),
)
_AMOUNT = "(100000 + 1000 * j + k % 100)"


def _filings(spark, d):
    each = "array_join(transform(sequence(0L, 4L), j -> {}), '')"
    shapes = "case k % 5 " + " ".join(f"when {i} then concat('{a}', {each.format(x)}, '{z}')" for i, (a, x, z) in enumerate(_SHAPES)) + " end"
    fees = f"if(k % 2 = 0 or k % 5 = 4, concat('<table><tr><th>Name</th><th>Fees Earned</th><th>Total ($)</th></tr>', {each.format(f'''concat('<tr><td>', {_NAME}, '</td><td>50,000</td><td>$', format_number({_AMOUNT}, 0), '</td></tr>')''')}, '</table>'), '')"
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).withColumn("html", F.expr(f"concat('<html><body>', {shapes}, {fees}, '</body></html>')"))


def director_tables(spark, d):
    """Directors of each filing with what its shape tells."""
    found = fl.filed_directors(_filings(spark, d), "k", "html")
    return found.select("k", "name", F.col("age").cast("long").alias("age"), F.col("since").cast("long").alias("since"), "independent", "compensation", F.array_join("committees", ",").alias("committees"), "shape")


_G, _F = (("[" + ", ".join(f"'{x}'" for x in xs) + "]") for xs in (GIVEN, FAMILY))
DIRECTORS = f"""WITH f AS (SELECT s_suppkey k, j, s_suppkey % 5 s FROM supplier, range(5) g(j))
SELECT k, {_G}[(k + j) % 7 + 1] || ' ' || ['A', 'B', 'C'][k % 3 + 1] || '. ' || {_F}[(2 * k + j) % 11 + 1] AS name, CASE WHEN s < 4 THEN 40 + (k + j) % 40 END age, CASE WHEN s < 4 THEN 1990 + (k + 3 * j) % 30 END since,
CASE WHEN s IN (1, 3) THEN j % 2 = 0 WHEN s = 0 AND j % 2 = 0 THEN true END independent, CASE WHEN k % 2 = 0 OR s = 4 THEN (100000 + 1000 * j + k % 100)::DOUBLE END compensation,
CASE WHEN s IN (0, 1, 3) THEN CASE j % 3 WHEN 0 THEN 'Audit' WHEN 1 THEN 'Finance,Risk' ELSE '' END ELSE '' END committees, ['small_table', 'summary', 'paragraph', 'block', 'compensation'][s + 1] shape FROM f"""

SQL = {"director_tables": DIRECTORS}
QUERIES = {"director_tables": director_tables}
