"""Golden cases of the column transforms."""

from pyspark.sql import functions as F

from tessera.functions import transforms as T

# fmt: off
CASES = {
'collapse_whitespace':[('  a  b  ',' a b ')],'extract_numbers':[('a1 b2.5 c','1 2.5')],'fix_mojibake':[('cafÃ©','café'),('café','café')],'pad_left':[('42','0000000042'),('12345678901','12345678901')],
'remove_emojis':[('hi 😀!','hi !')],'name_proper':[("o'brien mary-ann","O'Brien Mary-Ann"),('mcdonald','McDonald')],'name_initials':[('John Ronald Tolkien','JRT')],'name_script':[('Иван','Cyrillic'),('John','Latin')],
'name_transliterate':[('Æsir Straße é','AEsir Strasse e')],'nickname_standardize':[('Bob','Robert'),('Zed','Zed')],'strip_middle':[('John Q Public','John Public')],'strip_suffixes':[('John Smith Jr.','John Smith'),('John Smith, PhD','John Smith')],'strip_titles':[('Dr. John','John')],
'email_normalize':[('J.Doe+x@GMail.com','jdoe@gmail.com'),('bad','bad')],'email_canonical':[('j.d@googlemail.com','jd@gmail.com')],'email_mask':[('john@example.com','j***@example.com'),('x',None)],
'url_normalize':[('Example.com/','https://example.com'),('',None),('HTTP://A.com/Path','http://a.com/Path')],'url_extract_domain':[('https://www.A.com:80/x','www.a.com')],'url_strip_tracking':[('https://a.com/?utm_source=x&b=1','https://a.com/?b=1'),('https://a.com/?gclid=1','https://a.com/')],'url_canonical':[('http://www.a.com/?utm_x=1','http://a.com')],
'phone_e164':[('(212) 555-0100','+12125550100'),('x','x'),('+44 20 7946 0958','+442079460958')],'phone_national':[('2125550100','(212) 555-0100')],'phone_country_code':[('+44 20 7946 0958',44)],
'date_iso8601':[('03/05/1999','1999-03-05'),('1999','1999-01-01'),('xx','xx'),('5 Mar 1999','1999-03-05'),('March 5, 1999','1999-03-05')],'datetime_iso8601':[('1999-03-05','1999-03-05T00:00:00')],'extract_day_of_week':[('2024-01-01','Monday')],'extract_year':[('2024-01-01',2024)],'date_shift:3':[('2024-02-27','2024-03-01')],
'comma_decimal':[('1.234,56',1234.56),('12.5',12.5)],'currency_strip':[('$1,234.50',1234.5),('x',None)],'fraction_to_decimal':[('1/2',.5),('3 3/4',3.75),('2',2.0)],'ordinal_to_int':[('1st',1),('first',1),('x',None)],'percentage_normalize':[('85%',.85)],'roman_to_int':[('XIV',14),('MCMXCIX',1999),('IIII',None)],'to_integer':[('3.9',3)],'boolean_normalize':[('Yes',True),('zz',None)],
'company_extract_legal':[('Acme Inc.','inc'),('Acme',None)],'company_normalize':[('The Acme Co., Ltd.','acme')],'company_strip_legal':[('Acme Corp','Acme')],'address_standardize':[('12 main street','12 Main St')],'address_expand':[('12 Main St.','12 Main Street')],'state_abbreviate':[('Pennsylvania','PA')],'state_expand':[('pa','Pennsylvania')],'unit_normalize':[('Apt. 5','Unit 5'),('#5','Unit 5')],'zip_normalize':[('501','00501'),('12345-6789','12345'),('ab','ab')],
'aba_validate':[('021000021',True),('021000022',False)],'cc_brand':[('4111111111111111','visa'),('378282246310005','amex')],'cc_format':[('4111111111111111','4111 1111 1111 1111')],'cc_validate':[('4111 1111 1111 1111',True),('4111111111111112',False)],'cusip_validate':[('037833100',True),('037833101',False)],'ean_validate':[('4006381333931',True),('4006381333932',False)],'iban_validate':[('GB82 WEST 1234 5698 7654 32',True),('GB82WEST12345698765433',False)],'isbn_normalize':[('0-306-40615-2','9780306406157')],'isbn_validate':[('0306406152',True),('9780306406157',True),('0306406153',False)],'isin_validate':[('US0378331005',True),('US0378331006',False)],'npi_validate':[('1234567893',True)],'ssn_mask':[('123-45-6789','***-**-6789')],'ssn_validate':[('123456789',True),('000456789',False)],'swift_validate':[('DEUTDEFF',True),('XX',False)],'vat_validate':[('DE123456789',True)],'soundex':[('Robert','R163'),('123',''),('Éric','E620')],'icd10_format':[('e119','E11.9')],'derive_initialism':[('International Business Machines Corp','IBM')],
'split_name':[('Ann Lee',('Ann','Lee'))],'split_address':[('1 A St, Town, PA 12345',('1 A St','Town','PA','12345'))],'gender_standardize':[('Male','M')],'round:2':[(2.345,2.35),(-2.5,-2.5)],'clamp':[(5.0,1.0)],'age_from_dob:2024-06-01':[('2000-06-02',23)],
}
# fmt: on


def test_golden_cases(spark):
    rows = [(n, v, want) for n, cs in CASES.items() for v, want in cs]
    for kind in (str, float):
        part = [(i, n, v, want) for i, (n, v, want) in enumerate(rows) if isinstance(v, kind)]
        values = {f"c{i}": v for i, _, v, _ in part}
        df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if kind is float else 'string'}" for k in values))
        got = df.select(*[T.apply(f"c{i}", n).alias(f"o{i}") for i, n, _, _ in part]).first()
        for i, n, v, want in part:
            g = got[f"o{i}"]
            assert (tuple(g) if isinstance(want, tuple) else g) == want, (n, v)


def test_null_stays_null_or_defined(spark):
    skip = {"category_from_file", "merge_name", "latlng_pack", "abs_value", "clamp", "fill_zero", "round"}
    names = [n for n in T.REGISTRY if n not in skip]
    df = spark.createDataFrame([(None,)], "v string").select(*[T.apply("v", n).alias(n) for n in names])
    row = df.first()
    assert all(row[n] in (None, False) or hasattr(row[n], "asDict") for n in names), [n for n in names if row[n] not in (None, False)]


def test_chain_and_unknown(spark):
    df = spark.createDataFrame([("  Hello   World ",)], "v string")
    assert df.select(T.chain("v", ["strip", "collapse_whitespace", "lowercase", "pad_left:12:-"]).alias("o")).first().o == "-hello world"
    try:
        T.apply(F.lit("x"), "no_such_transform")
        raise AssertionError
    except NotImplementedError:
        pass
