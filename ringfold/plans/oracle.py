"""SQL statements of the core tables for the checking engine, and a helper that
puts the ones a statement needs in front of it."""

from __future__ import annotations

# Added before rounding where exact ties are common (means of means), so that
# both engines round the same way.
NUDGE = 3.3e-9

TABLES = {
    "pixels": """
        select l_orderkey // 300 as measurement_id,
               cast(l_partkey % 32 as int) as row_idx,
               cast(l_orderkey % 32 as int) as col_idx,
               sum(l_quantity) as value,
               (l_orderkey // 300) % 10 as cal_id
        from lineitem group by all""",
    "calibrations": r"""
        select s_suppkey as cal_id, (160 + s_suppkey % 25)::double / 1e3 as distance_m,
               (2345 + s_suppkey % 3 * 150)::double / 1e6 as poni1,
               (2281 - s_suppkey % 4 * 150)::double / 1e6 as poni2,
               0.00015::double as pixel1, 0.00015::double as pixel2,
               0.1542::double as wavelength_nm,
               'Detector: Detector' || chr(10)
               || 'Detector_config: {"pixel1": 0.00015, "pixel2": 0.00015}' || chr(10)
               || 'Distance: 0.' || (160 + s_suppkey % 25) || chr(10)
               || 'Poni1: 0.00' || (2345 + s_suppkey % 3 * 150) || chr(10)
               || 'Poni2: 0.00' || (2281 - s_suppkey % 4 * 150) || chr(10)
               || 'Wavelength: 1.542e-10' as ponifile
        from supplier""",
    "measurements": """
        select o_orderkey as measurement_id, o_custkey as patient_id,
               case when o_orderstatus = 'F' then 'WAXS' else 'SAXS' end as type_measurement,
               c_mktsegment in ('BUILDING', 'MACHINERY') as cancer_diagnosis,
               case when o_orderkey % 7 = 0 then null
                    else (20 + o_custkey % 60)::double end as age,
               (o_orderkey % 40)::double as thickness,
               case when o_orderkey % 11 = 0 then null else o_orderkey % 10 end as cal_id,
               case when o_orderkey % 13 = 0 then null
                    when o_orderstatus = 'F' then 0.02::double else 0.16::double
               end as calculated_distance,
               case when o_orderstatus = 'F' then 20::double else 160::double
               end as calibration_manual_distance,
               o_totalprice as raw_score
        from orders join customer on o_custkey = c_custkey""",
    "profiles": """
        select vec_id as measurement_id, i - 1 as pos, i * 0.1::double as q,
               embedding[i]::double + 1 as intensity, label::bigint as label,
               vec_id % 40 as patient_id,
               case when vec_id % 2 = 0 then 'SAXS' else 'WAXS' end as type_measurement,
               label < 5 as cancer_diagnosis,
               len(embedding) as n_points,
               case when vec_id % 9 = 0 then null
                    else (30 + vec_id % 40)::double end as age
        from embeddings, unnest(generate_series(1, len(embedding))) t(i)""",
    "peaked": """
        select * replace (intensity + 2.0::double
                          * exp(-((q - (label * 0.3::double + 2.0::double)) ** 2) / 0.5::double)
                          as intensity) from profiles""",
    "scored": """
        select doc_id, quality as y_true, n_chars::double as y_score
        from labels join documents using (doc_id)""",
    "scored_models": """
        select m.model_id, doc_id, quality as y_true,
               ((n_chars * (2 * m.model_id + 1)) % 10007)::double as y_score
        from labels join documents using (doc_id),
             (select unnest(generate_series(0, 4)) as model_id) m""",
    # geometry of every pixel, and the smallest and largest q over the grid
    "grid": """
        select cal_id, r, c,
               4 * pi() / wavelength_nm * sin(atan2(sqrt(
                   ((c + 0.5::double) * pixel2 - poni2) ** 2
                   + ((r + 0.5::double) * pixel1 - poni1) ** 2), distance_m) / 2) as q
        from calibrations, range(0, 32) a(r), range(0, 32) b(c)""",
    "q_limits": """
        select cal_id, min(q) as q_lo, max(q) as q_hi from grid group by cal_id""",
    "geo": """
        select p.*, c.distance_m, c.poni1, c.poni2, c.pixel1, c.pixel2,
               c.wavelength_nm, l.q_lo, l.q_hi,
               4 * pi() / wavelength_nm * sin(atan2(sqrt(
                   ((col_idx + 0.5::double) * pixel2 - poni2) ** 2
                   + ((row_idx + 0.5::double) * pixel1 - poni1) ** 2), distance_m) / 2) as q,
               degrees(atan2((row_idx + 0.5::double) * pixel1 - poni1,
                             (col_idx + 0.5::double) * pixel2 - poni2)) as chi
        from pixels p join calibrations c using (cal_id) join q_limits l using (cal_id)""",
}

NEEDS = {
    "peaked": ["profiles"],
    "grid": ["calibrations"],
    "q_limits": ["grid"],
    "geo": ["pixels", "calibrations", "q_limits"],
}


def with_tables(needed: str, body: str) -> str:
    """``body`` is either a select, or further tables and a final select that
    starts with ``, name as (...)``."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in needed.split():
        add(name)
    head = ",\n".join(f"{n} as ({TABLES[n]})" for n in order)
    return f"with {head}\n{body.strip()}"
