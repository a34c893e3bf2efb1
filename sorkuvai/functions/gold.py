"""Words and sentences that tokenizers are measured on."""

# A word and its morphemes, to test cutting against.
GOLD = (
    ("போகவேண்டியிருந்தது", ("போக", "வேண்டிய", "இருந்த", "து")), ("படிக்கிறான்", ("படி", "க்கிறான்")), ("வருகிறார்கள்", ("வரு", "கிறார்கள்")),
    ("எழுதுவதற்கு", ("எழுது", "வதற்கு")), ("சொல்லவில்லை", ("சொல்ல", "வில்லை")), ("நடக்கும்", ("நட", "க்கும்")), ("பேசிக்கொண்டிருந்தான்", ("பேசி", "க்கொண்டிருந்தான்")),
    ("பார்க்கலாம்", ("பார்", "க்கலாம்")), ("செய்யப்படுகிறது", ("செய்ய", "ப்படுகிறது")), ("கற்றுக்கொள்ள", ("கற்று", "க்கொள்ள")), ("ஓடினான்", ("ஓடி", "னான்")),
    ("பாடுவாள்", ("பாடு", "வாள்")), ("சாப்பிட்டேன்", ("சாப்பிட்", "டேன்")), ("தூங்கினார்கள்", ("தூங்கி", "னார்கள்")), ("விளையாடுகிறோம்", ("விளையாடு", "கிறோம்")),
    ("படிப்பார்கள்", ("படி", "ப்பார்கள்")), ("எழுதினேன்", ("எழுதி", "னேன்")), ("கேட்டான்", ("கேட்", "டான்")), ("வீட்டிற்கு", ("வீட்", "டிற்கு")),
    ("பள்ளியில்", ("பள்ளி", "யில்")), ("மாணவர்களுக்கு", ("மாணவர்கள்", "உக்கு")), ("நாட்டின்", ("நாட்", "டின்")), ("ஊரிலிருந்து", ("ஊரில்", "இருந்து")),
    ("கடையிடம்", ("கடை", "யிடம்")), ("அழகான", ("அழக", "ான")), ("நல்லவன்", ("நல்ல", "வன்")), ("பெரியது", ("பெரிய", "து")), ("சிறியவள்", ("சிறிய", "வள்")),
    ("புதியவை", ("புதிய", "வை")), ("படிக்கவேண்டியதில்லை", ("படிக்க", "வேண்டிய", "தில்லை")), ("சொல்லிக்கொண்டிருக்கிறான்", ("சொல்லி", "க்கொண்டிருக்கிறான்")),
    ("வந்துகொண்டிருந்தார்கள்", ("வந்து", "கொண்டிருந்தார்கள்")), ("செய்யமுடியாதவர்கள்", ("செய்ய", "முடியாத", "வர்கள்")), ("போகவேண்டாம்", ("போக", "வேண்டாம்")),
    ("படித்தவன்", ("படித்த", "வன்")), ("வந்தவர்கள்", ("வந்த", "வர்கள்")), ("செய்தது", ("செய்த", "து")), ("கொடுத்தவள்", ("கொடுத்த", "வள்")), ("படிப்பது", ("படிப்", "பது")),
    ("செய்வது", ("செய்", "வது")), ("போவது", ("போ", "வது")), ("வருவது", ("வரு", "வது")), ("மேசையின்மேல்", ("மேசை", "யின்மேல்")), ("வீட்டுக்குள்", ("வீட்", "டுக்குள்")),
    ("மரத்தடியில்", ("மரத்தடி", "யில்")), ("தலைநகரம்", ("தலை", "நகரம்")), ("கல்வித்துறை", ("கல்வி", "த்துறை")), ("விமானநிலையம்", ("விமான", "நிலையம்")),
    ("புத்தகக்கடை", ("புத்தக", "க்கடை")), ("மருத்துவமனை", ("மருத்துவ", "மனை")), ("பல்கலைக்கழகம்", ("பல்கலை", "க்கழகம்")), ("வரமாட்டான்", ("வர", "மாட்டான்")),
    ("செய்யவில்லை", ("செய்ய", "வில்லை")), ("படிக்காதவன்", ("படிக்", "காதவன்")), ("போகாமல்", ("போகா", "மல்")), ("எழுதச்செய்தான்", ("எழுத", "ச்செய்தான்")),
    ("படிக்கவைத்தாள்", ("படிக்க", "வைத்தாள்")), ("வாருங்கள்", ("வாரு", "ங்கள்")), ("சொல்லுங்கள்", ("சொல்லு", "ங்கள்")), ("பாருங்கள்", ("பாரு", "ங்கள்")),
    ("வந்தால்", ("வந்", "தால்")), ("படித்தாலும்", ("படித்", "தாலும்")), ("போனாலும்", ("போனா", "லும்")), ("செய்தாலும்", ("செய்", "தாலும்")),
    ("போய்விட்டான்", ("போய்", "விட்டான்")), ("வந்துவிட்டாள்", ("வந்து", "விட்டாள்")), ("செய்துமுடித்தான்", ("செய்து", "முடித்தான்")), ("போகிறாயா", ("போகிறாய்", "ஆ")),
    ("வருவாளா", ("வருவாள்", "ஆ")), ("கணினிமயமாக்கல்", ("கணினி", "மயமாக்கல்")), ("தொழில்நுட்பவியலாளர்", ("தொழில்நுட்ப", "வியலாளர்")), ("மின்னணுவியல்", ("மின்", "னணுவியல்")),
    ("செயற்கைநுண்ணறிவு", ("செயற்கை", "நுண்ணறிவு")), ("தரவுத்தளம்", ("தரவு", "த்தளம்")), ("படிக்கின்ற", ("படிக்", "கின்ற")), ("எழுதுகின்ற", ("எழுது", "கின்ற")),
    ("வருகின்ற", ("வரு", "கின்ற")), ("அவன்தான்", ("அவன்", "தான்")), ("இதுவே", ("இது", "வே")), ("அவர்களும்", ("அவர்கள்", "உம்")),
    ("நடத்திக்கொண்டிருக்கிறார்கள்", ("நடத்தி", "க்கொண்டிருக்கிறார்கள்")), ("பேசிக்கொள்ளலாம்", ("பேசி", "க்கொள்ளலாம்")),
    ("படிக்கவேண்டியிருக்கிறது", ("படிக்க", "வேண்டியிருக்கிறது")), ("செய்யப்பட்டிருக்கிறது", ("செய்ய", "ப்பட்டிருக்கிறது")), ("கொண்டுவரப்பட்டது", ("கொண்டுவர", "ப்பட்டது")),
    ("வேகமாக", ("வேகம்", "ஆக")), ("அழகாக", ("அழக", "ாக")), ("நன்றாக", ("நன்ற", "ாக")), ("மெதுவாக", ("மெதுவ", "ாக")), ("மாணவர்கள்", ("மாணவர்", "கள்")),
    ("குழந்தைகள்", ("குழந்தை", "கள்")), ("பறவைகள்", ("பறவை", "கள்")), ("நாடுகள்", ("நாடு", "கள்")), ("மொழிகள்", ("மொழி", "கள்")),
)
