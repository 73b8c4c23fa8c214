from skirmish.llm import pages


def test_formulas_and_raw_text_stay():
    prose = "Some words of an article that goes on for a while, with a formula in it, "
    page = f"<body><article><p>{prose}<math><semantics><mrow><mi>x</mi><mspace/><mo>=</mo><mn>42</mn></mrow></semantics></math> and more.</p><xmp>Raw <b>text</b> &amp; marks, shown as they are in the page, for all to read.</xmp><p>{prose}end.</p></article><script>no</script></body>"
    text = pages.texts_of([page], pages.train())[0]
    assert text == f"{prose}x=42 and more.\nRaw <b>text</b> &amp; marks, shown as they are in the page, for all to read.\n{prose}end."
