from pyspark.sql import functions as F

from tenderloom.operators import labels


def test_label_parts_are_compiled(column_of):
    """Tokens as before, without lambdas; joints of whole texts that hold every sure joint of a phrase inside."""
    text = "-- the Data platform, a 12 가나다 x: of Of data ... end"
    assert column_of([text, "", "a"], labels.label_tokens) == [["Data", "platform", "12", "가나다", "Of", "data", "end"], [], []]
    assert "lambda" not in str(labels.label_tokens(F.lit(text)))
    joints = column_of([text], labels._joints)[0]
    assert joints[:3] == ["he  Da", "ta  pl", "rm, , a"] and len(joints) == 10
    phrases = ["the Data platform", "e Data p", "platform, a 12", "x: of Of", "data ... end"]
    assert all(set(sure) <= set(joints) for sure in column_of(phrases, labels._sure_joints))
    assert [len(sure) for sure in column_of(phrases, labels._sure_joints)] == [2, 0, 2, 1, 1]
